"""Expressions over sequences, sequence contexts and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the bases.
_FROM, _TO = "ACGTNacgtn", "TGCANtgcan"
#: Lower bounds of the level categories.
CATEGORIES = ((0.8, "M"), (0.6, "Mh"), (0.4, "H"), (0.2, "hU"))


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def c_to_t(seq: Column) -> Column:
    return F.translate(seq, "Cc", "Tt")


def g_to_a(seq: Column) -> Column:
    return F.translate(seq, "Gg", "Aa")


def centred(reference: Column, at: Column, flank: int) -> Column:
    """The bases ``at - flank .. at + flank`` (``at`` from 0) of a reference text, N beyond its ends."""
    n = 2 * flank + 1
    begin = at - flank
    inner = F.substring(reference, F.greatest(begin, F.lit(0)).cast("int") + 1, (at + flank + 1 - F.greatest(begin, F.lit(0))).cast("int"))
    return F.upper(F.rpad(F.concat(F.expr(f"repeat('N', {n})").substr(F.lit(1), F.greatest(-begin, F.lit(0)).cast("int")), inner), n, "N"))


def cytosine_context(next_two: Column) -> Column:
    """CG, CHG or CHH from the two bases after a cytosine on its own strand; null if one that matters is unknown."""
    a, b = F.upper(F.substring(next_two, 1, 1)), F.upper(F.substring(next_two, 2, 1))
    known = lambda c: c.isin("A", "C", "G", "T")
    return F.when(a == "G", "CG").when(known(a) & (b == "G"), "CHG").when(known(a) & known(b), "CHH")


def nome_class(triple: Column) -> Column:
    """WCG (endogenous) or GCH (accessibility) from the base before, the cytosine and the base after; else null."""
    t = F.upper(triple)
    return F.when(t.isin("ACG", "TCG"), "WCG").when(t.isin("GCA", "GCT", "GCC"), "GCH")


def level_category(level: Column) -> Column:
    """M, Mh, H, hU or U by the level; null stays null."""
    out = F.when(level.isNull(), F.lit(None).cast("string"))
    for least, name in CATEGORIES:
        out = out.when(level >= least, name)
    return out.otherwise("U")


def true_share(g: Column, a: Column, evidence: int = 20) -> Column:
    """Share of true bases among the other class's, g / (g + a); null unless more than ``evidence`` were seen and some are true."""
    return F.when((g + a > evidence) & (g > 0), g.cast("double") / (g + a).cast("double"))


def corrected_level(c: Column, t: Column, g: Column, a: Column, evidence: int = 20) -> Column:
    """C / (C + T), where ``true_share`` is known divided by it, 1 at most; null without coverage."""
    cover = F.when(c + t > 0, (c + t).cast("double"))
    plain = c.cast("double") / cover
    return F.coalesce(F.least(c.cast("double") / (cover * true_share(g, a, evidence)), F.when(plain.isNotNull() & true_share(g, a, evidence).isNotNull(), F.lit(1.0))), plain)


def clean_attribute(c: Column) -> Column:
    """A GTF attribute value without quotes and semicolons."""
    return F.translate(c, '";', "")
