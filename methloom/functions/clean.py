"""Defined groups for dirty site columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of a context, after trimming and upper case.
CONTEXT_NAMES = {"CPG": "CG", "CPHPG": "CHG", "CPHPH": "CHH"}
NO_GROUP = "(none)"


def clean_context(context: Column, site_name: Column | None = None) -> Column:
    """The context in upper case without blanks, CpG as CG; null or blank: that of the site name, else '(none)'."""
    def tidy(c: Column) -> Column:
        bare = F.upper(F.trim(c))
        named = bare
        for other, name in CONTEXT_NAMES.items():
            named = F.when(bare == other, name).otherwise(named)
        return F.when(bare != "", named)

    spare = [tidy(F.element_at(F.split(site_name, ":"), -1))] if site_name is not None else []
    return F.coalesce(tidy(context), *spare, F.lit(NO_GROUP))


def clean_chrom(chrom: Column, site_name: Column | None = None) -> Column:
    """The chrom as stored; null or blank: that of the site name, else '(none)'."""
    spare = [F.when(F.trim(site_name) != "", F.element_at(F.split(site_name, ":"), 1))] if site_name is not None else []
    return F.coalesce(F.when(F.trim(chrom) != "", chrom), *spare, F.lit(NO_GROUP))
