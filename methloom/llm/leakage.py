"""Evaluation passages inside training text, by suffix arrays over shards of the corpus."""

from __future__ import annotations

import html
import unicodedata
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methloom.core import ship, table_batches, written

#: A verbatim run of so many words is a leak.
RUN = 16
#: Or a stretch of so many words, of which no more than one in ONE_IN is replaced.
STRETCH, ONE_IN = 30, 6
#: A word may be replaced by one that is written as up to so many ("forty-one").
WRITTEN_AS = 3
#: Words of corpus text in one suffix array, and test items searched at a time.
SHARD_WORDS = 1_000_000
ITEMS_PER_PASS = 20_000

#: Inline tags, which don't part words.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|dfn|em|font|i|ins|del|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE_TAG = regex.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
#: The same with nothing but name=value after the name: words between "<" and a ">" further on may be text.
_VALUES = r"""(?:\s+[^\s<>"'/=]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"']+))*+\s*"""
_SURE_INLINE_TAG = regex.compile(rf"</?(?:{_INLINE}){_VALUES}/?>", regex.I)
_SURE_TAG = regex.compile(rf"</?[A-Za-z][A-Za-z0-9]*{_VALUES}/?>")
_COMMENT = regex.compile(r"<!--|-->")
_BBCODE = regex.compile(r"\[/?(?:b|i|u|s|quote|code|color|url|size|list|\*)(?:=[^\]]*)?\]", regex.I)
_LINK = regex.compile(r"\]\([^()\s]*\)")
_EMPHASIS = regex.compile(r"(?<=[\p{L}\p{N}])(?:\*{1,3}|_{2,3}|~~|`)(?=[\p{L}\p{N}])")
_UNICODE_ESCAPE = regex.compile(r"\\+u\{?([0-9A-Fa-f]{4,6})\}?|\\+U([0-9A-Fa-f]{8})|\\+x([0-9A-Fa-f]{2})")
_SURROGATES = regex.compile(r"\\+u([dD][89abAB][0-9A-Fa-f]{2})\\+u([dD][c-fC-F][0-9A-Fa-f]{2})")
_CONTROL_ESCAPE = regex.compile(r"\\+[ntrfvb](?![a-z]*\{)")
_PERCENT = regex.compile(r"(?:%[0-9A-Fa-f]{2})+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Marks on letters and characters that take no room.
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}\u115F\u1160\u3164\uFFA0\u0000-\u0008\u000E-\u001F\u007F]+")
_LATIN = regex.compile(r"[a-z]")
_NOT_LATIN = regex.compile(r"[^a-z0-9]")

#: Letters and the Latin ones they look like, in lower case.
_ALIKE = str.maketrans(
    "абсԁеһіјкӏмнорԛгѕтуѵԝхєαβγεηικνορτυχωϲϳԍաօսոհցզɑɡıȷʏοɩᴀᴄᴅᴇᴋᴍᴏᴘᴛᴜᴠᴡᴢ",
    "abcdehijklmhopqrstyvwxeabyenikvoptuxwcjgaouuhgqagijyoiacdekmoptuvwz",
)
#: In a word that has Latin letters, also these.
_ALIKE_MIXED = str.maketrans("вз01", "b3ol")
_DOTLESS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h"})


def _chr(m: regex.Match) -> str:
    n = int(m[1] or m[2] or m[3], 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "


def _pair(m: regex.Match) -> str:
    return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)


def _percent(m: regex.Match) -> str:
    try:
        return urllib.parse.unquote(m[0], errors="strict")
    except UnicodeDecodeError:
        return m[0]


def _plain(word: str) -> str:
    """The word with letters of other scripts read as the Latin ones they look like, where it then is Latin."""
    if word.isascii() and (word.isalpha() or word.isdigit()):
        return word
    as_latin = word.translate(_DOTLESS).translate(_ALIKE)
    if _LATIN.search(word):
        return as_latin.translate(_ALIKE_MIXED)
    return as_latin if not _NOT_LATIN.search(as_latin) else word


def readings(text: str | None) -> list[list[str]]:
    """The text's words with all that may be a tag left out and, where it differs, with only what must be one left out."""
    loose = words(text)
    if not text or ">" not in text and "&" not in text and "\\" not in text and "%" not in text:
        return [loose]
    sure = words(text, sure_tags=True)
    return [loose] if sure == loose else [loose, sure]


def words(text: str | None, sure_tags: bool = False) -> list[str]:
    """The text's words as the comparison sees them.

    Case, marks, punctuation, line breaks, quote and comment signs, tags, escapes
    (entities, backslash and percent), invisible and look-alike characters don't
    matter. Null and empty texts have none.
    """
    if not text:
        return []
    if "\\" in text:
        text = _CONTROL_ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(_chr, _SURROGATES.sub(_pair, text)))
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    for _ in range(3):
        if "&" not in text or (plain := html.unescape(text)) == text:
            break
        text = plain
    if "<" in text:
        inline, tag = (_SURE_INLINE_TAG, _SURE_TAG) if sure_tags else (_INLINE_TAG, _TAG)
        text = tag.sub(" ", inline.sub("", _COMMENT.sub(" ", text)))
    if "[" in text:
        text = _LINK.sub(" ", _BBCODE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).casefold())
        text = unicodedata.normalize("NFC", _UNSEEN.sub("", text))
    else:
        text = _UNSEEN.sub("", text).lower()
    text = _EMPHASIS.sub("", text)
    return [_plain(w) for w in _WORD.findall(text)]


class SuffixArray:
    """The suffixes of a shard's words in order, with the length of the common beginning of any two texts.

    ``text`` holds word numbers, 0 for a word in no passage and after each document;
    a suffix ends before the next 0. Suffixes are ordered by doubling of ranks to
    ``depth`` words, which no passage exceeds. Suffixes in runs of fewer than
    ``least`` known words can't match and are left out.
    """

    def __init__(self, text: np.ndarray, depth: int, least: int):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (text > 0).astype(np.int8), [0]])))
        begin, end = edge[0::2], edge[1::2]
        long_ = end - begin >= least
        begin, n = begin[long_], (end - begin)[long_]
        total = int(n.sum())
        index = np.arange(total)
        own = np.repeat(np.cumsum(n) - n, n)
        #: Place in ``text`` of each suffix's first word, and where its run ends, in places of ``words``.
        self.place = index - own + np.repeat(begin, n)
        self.words, self.end = text[self.place], own + np.repeat(n, n)
        rank = np.unique(self.words, return_inverse=True)[1] + 1
        h = 1
        while h < depth and total and rank.max() < total:
            after = np.where(index + h < self.end, rank[np.minimum(index + h, total - 1)], 0)
            rank = np.unique(rank * np.int64(total + 1) + after, return_inverse=True)[1] + 1
            h *= 2
        self.order = np.argsort(rank, kind="stable")


class Beginnings:
    """Polynomial fingerprints of all stretches of two word arrays, to tell how far two suffixes agree."""

    BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, *arrays: np.ndarray):
        n = max((len(a) for a in arrays), default=0) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.INVERSE)]), dtype=np.uint64)
            self.sums = []
            for a in arrays:
                x = a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(x * power[: len(a)], dtype=np.uint64)]))

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words in which the stretches from ``a`` (first array) and ``b`` (second) agree, ``most`` at most."""
        one, two = self.sums
        low, high = np.zeros(len(a), np.int64), most.copy()
        with np.errstate(over="ignore"):
            while (open_ := low < high).any():
                mid = np.where(open_, (low + high + 1) // 2, low)
                same = (one[a + mid] - one[a]) * self.back[a] == (two[b + mid] - two[b]) * self.back[b]
                low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low


class TestSet:
    """Test passages as word numbers, with every suffix."""

    __test__ = False

    def __init__(self, names: pa.Array, passages: list[list[str]], vocab: dict[str, int], run: int, stretch: int, one_in: int):
        self.names, self.run, self.stretch, self.one_in = names, run, stretch, one_in
        self.seed = seed_words(run, stretch, one_in)
        numbered = [np.array([vocab[w] for w in p], np.int64) for p in passages]
        self.length = np.array([len(p) for p in numbered], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*numbered, np.empty(0, np.int64)])
        self.owner = np.repeat(np.arange(len(numbered)), self.length)
        left = (self.start + self.length)[self.owner] - np.arange(len(self.flat))
        #: Suffixes long enough to hold a seed, by their place in ``flat``.
        self.suffix = np.flatnonzero(left >= self.seed)
        self.left = left[self.suffix]

    def search(self, text: np.ndarray, doc_start: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, place in the document, longest verbatim run, words of the longest near stretch) of each leak.

        Every test suffix is sought in the shard's suffix array by binary search,
        which gives its longest verbatim match; those that match in a seed's
        length at least are looked up to that depth, for all their places.
        """
        if not len(self.suffix):
            return []
        sa = SuffixArray(text, int(self.length.max()), self.seed)
        if not len(sa.order):
            return []
        both = Beginnings(sa.words, self.flat)
        n = len(sa.order)

        def common(at: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
            a = sa.order[at]
            return both.agree(a, self.suffix[q], np.minimum(sa.end[a] - a, most))

        def bound(q: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
            """The first place in the order whose suffix isn't less than (with ``right``: is greater than) the query's first ``most`` words."""
            lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n)
            while (open_ := lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                k, a = common(mid, q, most), sa.order[mid]
                whole = k == most
                # A suffix that ends within the query is less than it.
                next_ = np.where(a + k < sa.end[a], sa.words[np.minimum(a + k, n - 1)], 0)
                less = np.where(whole, right, next_ < self.flat[np.minimum(self.suffix[q] + k, len(self.flat) - 1)])
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        q = np.arange(len(self.suffix))
        at = bound(q, self.left, False)
        longest = np.maximum(np.where(at < n, common(np.minimum(at, n - 1), q, self.left), 0), np.where(at > 0, common(np.maximum(at - 1, 0), q, self.left), 0))
        q = q[longest >= self.seed]
        depth = np.full(len(q), self.seed)
        lo, hi = bound(q, depth, False), bound(q, depth, True)
        found: list[tuple[int, int, int, int, int]] = []
        done, total = 0, np.cumsum(hi - lo)
        while done < len(q):  # in blocks of bounded size
            before = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, before + 2_000_000, "right")))
            c = (hi - lo)[done:stop]
            of = np.repeat(q[done:stop], c)
            where = sa.place[sa.order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[done:stop], c)]]
            item = self.owner[self.suffix[of]]
            found += self.verify(text, doc_start, item, where - (self.suffix[of] - self.start[item]), where)
            done = stop
        return found

    def verify(self, text: np.ndarray, doc_start: np.ndarray, item: np.ndarray, diagonal: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Extend each pair of item and diagonal over the whole passage."""
        doc = np.searchsorted(doc_start, where, "right") - 1
        pairs = np.unique(np.stack([item, diagonal, doc], 1), axis=0)
        ends = np.append(doc_start[1:], len(text))
        rest: list[np.ndarray] = []
        pairs = pairs[np.argsort(self.length[pairs[:, 0]], kind="stable")]
        cells = np.cumsum(self.length[pairs[:, 0]])
        cuts = np.searchsorted(cells, np.arange(2_000_000, int(cells[-1]) if len(cells) else 0, 2_000_000))
        out = []
        for part in np.split(pairs, np.unique(cuts)):
            if not len(part):
                continue
            item, diag, doc = part.T
            width = int(self.length[item].max())
            j = np.arange(width)
            pos = diag[:, None] + j
            inside = (j < self.length[item][:, None]) & (pos >= doc_start[doc][:, None]) & (pos < ends[doc][:, None])
            same = inside & (text[np.clip(pos, 0, len(text) - 1)] == self.flat[np.minimum(self.start[item][:, None] + j, len(self.flat) - 1)])
            # Longest verbatim run.
            n = np.cumsum(same, 1)
            broken = np.maximum.accumulate(np.where(same, 0, n), 1)
            longest = (n - broken).max(1)
            near = self.longest_near(same, inside)
            leak = (longest >= self.run) | (near >= self.stretch)
            for r in np.flatnonzero(leak):
                out.append((int(doc[r]), int(item[r]), int(max(diag[r] - doc_start[doc[r]], 0)), int(longest[r]), int(near[r]) if near[r] >= self.stretch else 0))
            rest.append(np.column_stack([part, longest])[~leak])
        if rest:
            out += self.shifted(text, doc_start, ends, np.concatenate(rest), {(d, i) for d, i, *_ in out})
        return out

    def shifted(self, text: np.ndarray, doc_start: np.ndarray, ends: np.ndarray, rows: np.ndarray, known: set[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Near stretches that change their diagonal where a word was replaced by several, for pairs that aren't leaks on one diagonal.

        A near stretch of twice ``stretch`` words or more has a near half, so there is
        one of fewer words, with so few replaced ones that its diagonals lie within
        a band of the seed's. Only pairs of which enough words occur in the band in
        a stretch's length are aligned.
        """
        band = (2 * self.stretch - 1) // self.one_in * (WRITTEN_AS - 1)
        rows = rows[self.length[rows[:, 0]] >= self.stretch]
        rows = rows[[(d, i) not in known for i, _, d, _ in rows.tolist()]] if len(rows) else rows
        out, enough = [], self.stretch - self.stretch // self.one_in
        for part in np.array_split(rows, max(1, -(-int(self.length[rows[:, 0]].sum()) // 1_000_000))):
            if not len(part):
                continue
            item, diag, doc = part[:, 0], part[:, 1], part[:, 2]
            j = np.arange(int(self.length[item].max()))
            mine = np.where(j < self.length[item][:, None], self.flat[np.minimum(self.start[item][:, None] + j, len(self.flat) - 1)], -1)
            first, last = doc_start[doc][:, None], ends[doc][:, None]
            some = np.zeros(mine.shape, bool)
            for shift in range(-band, band + 1):
                at = diag[:, None] + j + shift
                some |= (text[np.clip(at, 0, len(text) - 1)] == mine) & (at >= first) & (at < last)
            n = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(some, 1)], 1)
            for r in np.flatnonzero((n[:, self.stretch :] - n[:, : -self.stretch]).max(1) >= enough):
                at = diag[r] + j[: self.length[item[r]], None] + np.arange(-band, band + 1)
                inside = (at >= doc_start[doc[r]]) & (at < ends[doc[r]])
                size = self.aligned((text[np.clip(at, 0, len(text) - 1)] == mine[r, : self.length[item[r]], None]) & inside, inside)
                if size >= self.stretch:
                    out.append((int(doc[r]), int(item[r]), int(max(diag[r] - doc_start[doc[r]], 0)), int(part[r, 3]), size))
        return out

    def aligned(self, same: np.ndarray, inside: np.ndarray) -> int:
        """Words of the longest near stretch in a band: ``same[j, k]`` if word j of the passage is the text's on diagonal k.

        For each begin, the best sum on each diagonal is carried from word to word: a
        same word counts 1 and stays, another one 1 - ``one_in`` and goes on by the
        words it is written as.
        """
        n, width = same.shape
        total, best = np.full((n, width), -1 << 30, np.int64), 0
        for j in range(n):
            total[j] = np.where(inside[j], 0, -1 << 30)  # a stretch that begins here
            lost = np.where(inside[j], total + 1 - self.one_in, -1 << 30)
            new = np.where(same[j], total + 1, lost)
            for more in range(1, WRITTEN_AS):
                new[:, more:] = np.maximum(new[:, more:], lost[:, :-more])
            total = new
            begun = np.flatnonzero((total[: j + 1] >= 0).any(1))
            if len(begun):
                best = max(best, j + 1 - int(begun[0]))
        return best

    def longest_near(self, same: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Longest stretch of each row in which at most one word in ``one_in`` isn't the same, in one pass over the places.

        A same word counts 1, another one 1 - ``one_in``; a stretch is near if its
        sum isn't negative. The least sum up to each begin and the greatest from
        each end on are met by two pointers.
        """
        rows, width = same.shape
        gain = np.where(inside, np.where(same, 1, 1 - self.one_in), -self.one_in * width)
        total = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(gain, 1)], 1)
        low, high = np.minimum.accumulate(total, 1), np.maximum.accumulate(total[:, ::-1], 1)[:, ::-1]
        each, i, j, best = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        while (open_ := j <= width).any():
            fits = low[each, np.minimum(i, width)] <= high[each, np.minimum(j, width)]
            best = np.where(open_ & fits, np.maximum(best, j - i), best)
            i, j = np.where(open_ & ~fits, i + 1, i), np.where(open_ & (fits | (i + 1 > j)), j + 1, j)
        return best


def seed_words(run: int, stretch: int, one_in: int) -> int:
    """The verbatim run that any stretch with its replaced words holds at least."""
    allowed = stretch // one_in
    return max(1, min(run, -(-(stretch - allowed) // (allowed + 1))))


class Items:
    """The test items of a table in the shared folder, as blocks of ``per_pass`` passages; one block is kept, more are read again for each shard."""

    def __init__(self, path: str, per_pass: int, run: int, stretch: int, one_in: int):
        self.path, self.per_pass, self.setting = path, per_pass, (run, stretch, one_in)
        self.vocab: dict[str, int] = {}
        blocks = 0
        for _, passages in self.rows():
            blocks += 1
            for p in passages:
                for w in p:
                    self.vocab.setdefault(w, len(self.vocab) + 1)
        self.kept = list(self.sets()) if blocks <= 1 else None

    def rows(self) -> Iterator[tuple[pa.Array, list[list[str]]]]:
        for batch in table_batches(self.path, self.per_pass):
            yield batch.column("item"), batch.column("ws").to_pylist()

    def sets(self) -> Iterator[TestSet]:
        return (TestSet(names, passages, self.vocab, *self.setting) for names, passages in self.rows())

    def __iter__(self) -> Iterator[TestSet]:
        return iter(self.kept) if self.kept is not None else self.sets()


def find_leaks(
    corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str,
    run: int = RUN, stretch: int = STRETCH, one_in: int = ONE_IN, shard_words: int = SHARD_WORDS, items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """Every pair of a corpus text and a test item whose passage it holds, fully or partly.

    Each shard of the corpus becomes a suffix array; every suffix of every
    passage is looked up by binary search, for its longest verbatim match and for
    all places where it agrees in a seed's length. These are extended along their
    diagonal over the whole passage, which gives the longest verbatim run (leak:
    ``run`` words) and the longest stretch with few replaced words (leak: ``stretch``
    words, one in ``one_in`` replaced). A word may be replaced by one that is written
    as up to WRITTEN_AS words, which moves the rest to another diagonal; such
    stretches are aligned in a band around the seed. Any near stretch holds a
    verbatim run of the seed's length. The items are a table in the
    shared folder, which each worker reads in blocks of ``items_per_pass``: the
    corpus is scanned once however many they are, and never shuffled; only leaks
    are grouped. A worker holds the items' vocabulary, one block and one shard.

    Returns one row per pair: ``id_col``, ``item_col``, ``longest_run``,
    ``longest_stretch`` (0 if shorter than ``stretch``), ``first_word`` (place of
    the match, in words). Null and empty texts and passages have no words and
    give no rows, nor do passages of fewer than ``run`` words (16). Rows that
    share an id count as one text's parts. Empty tables give no rows.
    """
    spark = corpus.sparkSession
    ship(spark)
    id_kind, item_kind = corpus.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    docs = corpus.select(corpus[f"`{id_col}`"].alias("id"), corpus[f"`{text_col}`"].cast("string").alias("text"))
    schema = f"id {id_kind}, item {item_kind}, longest_run int, longest_stretch int, first_word int"
    wanted = items.select(items[f"`{item_col}`"].alias("item"), items[f"`{passage_col}`"].cast("string").alias("passage")).where("passage is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(p) for p in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "ws"])

    path = written(wanted.mapInArrow(split, f"item {item_kind}, ws array<string>").where(F.size("ws") >= run))
    seed = seed_words(run, stretch, one_in)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(path, items_per_pass, run, stretch, one_in)
        ids: list[pa.Scalar] = []
        shard: list[int] = []
        starts: list[int] = []

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            text, begin = np.array(shard, np.int64), np.array(starts, np.int64)
            for tests in items:
                rows = tests.search(text, begin)
                d, i, w, r, s = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k].as_py() for k in d], id_type), tests.names.take(pa.array(i, pa.int64())), *(pa.array(c, pa.int32()) for c in (r, s, w))],
                    names=["id", "item", "longest_run", "longest_stretch", "first_word"],
                )
            ids.clear(), shard.clear(), starts.clear()

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0), batch.column(1)):
                for ws in readings(text.as_py()):
                    if len(ws) < seed:
                        continue
                    ids.append(name)
                    starts.append(len(shard))
                    shard += [items.vocab.get(w, 0) for w in ws]
                    shard.append(0)
                if len(shard) >= shard_words:
                    yield from flush(id_type)
        if ids:
            yield from flush(id_type)

    pairs = docs.mapInArrow(go, schema)
    best = pairs.groupBy("id", "item").agg(
        F.max("longest_run").alias("longest_run"), F.max("longest_stretch").alias("longest_stretch"),
        F.min_by("first_word", F.struct(-F.col("longest_run"), -F.col("longest_stretch"), "first_word")).alias("first_word"),
    )
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "longest_run", "longest_stretch", "first_word")


def without_leaks(corpus: DataFrame, id_col: str, leaks: DataFrame) -> DataFrame:
    """The corpus rows whose id is in no leak; rows with a null id stay."""
    return corpus.join(leaks.select(F.col(id_col).alias("_leak")).distinct(), corpus[f"`{id_col}`"] == F.col("_leak"), "left_anti")
