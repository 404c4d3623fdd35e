"""Content-defined chunking of long texts, snapped to the text's own boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from methloom.core import ship
from methloom.llm.bpe import TOKENIZERS, Encoder, encoder

LIMIT, OVERLAP = 512, 64
#: Least tokens of new text in a piece, where a boundary allows it.
LEAST = 256
#: Pre-tokens under the rolling hash, and one landmark in so many pre-tokens.
WINDOW, EVERY = 8, 128
#: Hashes of pre-tokens that a worker remembers.
MEMO = 200_000

#: Where a piece may end, strongest first; a cut lies after the match, or before the lookahead.
_BOUNDARIES = (
    (5, regex.compile(r"\n[ \t\r]*\n\s*")),  # paragraphs
    (5, regex.compile(r"\n(?=[ \t]*(?:```|~~~))|(?<=\n)[ \t]*(?:```|~~~)[^\n]*\n|(?=<pre\b)|</pre>\s*", regex.I)),  # code blocks
    (4, regex.compile(r"\n(?=[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t])|(?=<li\b)|</li>\s*|</p>\s*|<br ?/?>\s*", regex.I)),  # list items
    (3, regex.compile(r"\r?\n|\r")),  # lines
    (2, regex.compile(r"[.!?;…]+[\"'”’)\]]*(?=\s)|[。！？；।]+[」』”）]*")),  # sentences
)
_SNAP = {5: 1.0, 4: 0.8, 3: 0.6, 2: 0.4}


class Cutter:
    """Cuts one text; see ``split_long_texts``."""

    def __init__(self, enc: Encoder, limit: int, overlap: int, least: int):
        self.enc, self.limit, self.overlap, self.least = enc, limit, overlap, least
        self.hashes: dict[str, int] = {}

    def units(self, pieces: list[str], n: list[int]) -> tuple[list[int], list[int], list[str]]:
        """Character and token offsets of the places where a cut is possible at all, and the texts between."""
        if max(n, default=0) > 16:
            parts, sizes = [], []
            for p, k in zip(pieces, n):
                # A run of letters or signs with no boundary of its own.
                cut = [p] if k <= 16 else [p[i : i + 8] for i in range(0, len(p), 8)]
                parts += cut
                sizes += [k] if k <= 16 else [self.enc.count(q) for q in cut]
            pieces, n = parts, sizes
        chars = np.concatenate([[0], np.cumsum(list(map(len, pieces)))])
        return chars.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist(), pieces

    def landmarks(self, parts: list[str]) -> np.ndarray:
        """Units after which the rolling hash of the last WINDOW units says so."""
        memo = self.hashes
        if len(memo) > MEMO:
            memo.clear()
        for p in set(parts).difference(memo):
            memo[p] = xxhash.xxh3_64_intdigest(p)
        h = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
        roll = np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(WINDOW, len(h))):
                mult = np.uint64(pow(0x100000001B3, k, 1 << 64))
                roll[k:] += h[: len(h) - k] * mult
            roll = (roll ^ (roll >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return np.flatnonzero((roll >> np.uint64(40)) % np.uint64(EVERY) == 0) + 1

    def naturals(self, text: str, chars: list[int]) -> dict[int, int]:
        """Strength of each natural boundary, by unit. A boundary inside a unit moves to the unit's end."""
        out: dict[int, int] = {}
        for strength, pat in _BOUNDARIES:
            for m in pat.finditer(text):
                u = bisect_left(chars, m.end())
                if 0 < u < len(chars) - 1 and strength > out.get(u, 0):
                    out[u] = strength
        return out

    def cut(self, text: str) -> list[tuple[int, int, int, int]] | None:
        """(begin, start of new text, end, tokens) of each piece; None if the text is within the limit."""
        if 4 * len(text) <= self.limit or len(text.encode()) <= self.limit:
            return None
        pieces, n = self.enc.counts(text)
        if sum(n) <= self.limit:
            return None
        # Within a run that units() splits, tokens of a part can only be counted anew.
        plain = max(n) <= 16
        chars, toks, parts = self.units(pieces, n)

        def size(a: int, b: int) -> int:
            """Tokens of the units a .. b - 1 encoded by themselves: the sum of their own, but that white space at the end is one run."""
            if not plain:
                return self.enc.count(text[chars[a] : chars[b]])
            k = b
            while k > a and parts[k - 1].isspace():
                k -= 1
            return toks[k] - toks[a] + (self.enc.count(text[chars[k] : chars[b]]) if b - k > 1 else toks[b] - toks[k])

        marks, nat = self.landmarks(parts), self.naturals(text, chars)
        places = sorted(nat)
        out, at, last = [], 0, len(parts)
        while at < last:
            # The overlap: as many of the units before as have at most `overlap` tokens.
            begin = at
            if out:
                floor = bisect_left(chars, out[-1][0])
                begin = max(bisect_left(toks, toks[at] - self.overlap), floor)
                while begin < at and size(begin, at) > self.overlap:
                    begin += 1
            far = max(bisect_right(toks, toks[begin] + self.limit) - 1, at + 1)
            end = last if far >= last else self.snap(at, far, toks, marks, nat, places)
            n = size(begin, end)
            while n > self.limit:  # the ends of a piece can change how white space is cut
                if end - at > 1:
                    lower = places[max(0, bisect_left(places, end) - 1)] if places and places[0] < end else 0
                    end = lower if lower > at else end - 1
                else:
                    begin += 1
                n = size(begin, end)
            out.append((chars[begin], chars[at], chars[end], n))
            at = end
        return out

    def snap(self, at: int, far: int, toks: list[int], marks: np.ndarray, nat: dict[int, int], places: list[int]) -> int:
        near = bisect_left(toks, toks[at] + self.least)
        k = int(np.searchsorted(marks, near))
        target = int(marks[k]) if k < len(marks) and marks[k] <= far else far
        a, b = bisect_left(places, max(at + 1, min(near, far))), bisect_right(places, far)
        if a == b:  # none beyond the least size: any that the text has
            a = bisect_right(places, at)
        if a < b:
            # The nearest boundary to the landmark, a stronger one counting as nearer.
            return min(places[a:b], key=lambda u: (abs(toks[u] - toks[target]) / _SNAP[nat[u]], u))
        return max(min(target, far), at + 1)


def split_long_texts(
    df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST,
    name: str = "byte_bpe_50k", folder: str = TOKENIZERS,
) -> DataFrame:
    """Cut every text of more than ``limit`` tokens into pieces of at most ``limit`` tokens.

    Landmarks, chosen by a rolling hash over the content, are snapped to the
    nearest paragraph, code block, list item, line or sentence end within the
    allowed sizes, so that an edit moves only the neighbouring cuts. A text
    without such a boundary in reach is cut at a landmark between words, and a
    run without words within the run. Each piece after the first starts with the
    last ``overlap`` tokens or fewer of the one before.

    Returns ``id_col``, ``piece_no`` (from 1), ``n_tokens`` (of the piece encoded
    by itself), ``start_char``, ``new_from_char``, ``end_char`` (code points of
    the text) and ``piece``. Texts within the limit, empty and null ones give no
    rows, so does an empty table. Repeated ids are cut row by row. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(encoder(name, folder), limit, overlap, least)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, src = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                for k, (begin, new, end, n) in enumerate(cutter.cut(text) or () if text else ()):
                    src.append(i)
                    rows.append((k + 1, n, begin, new, end, text[begin:end]))
            if rows:
                cols = list(zip(*rows))
                arrays = [ids.take(pa.array(src))] + [pa.array(c, pa.int32()) for c in cols[:5]] + [pa.array(cols[5], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece_no", "n_tokens", "start_char", "new_from_char", "end_char", "piece"])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[f"`{id_col}`"].alias("id"), df[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, piece_no int, n_tokens int, start_char int, new_from_char int, end_char int, piece string"
    )
    return out.withColumnRenamed("id", id_col)
