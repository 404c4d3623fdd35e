"""Brute-force checks, round trips and edge cases of the training-data operators."""

import random

import numpy as np
import pytest

from methloom.llm.bpe import PerfectHash, encode_corpus, encoder
from methloom.llm.chunking import Cutter, split_long_texts
from methloom.llm.leakage import find_leaks, without_leaks, words
from methloom.llm.percentiles import combine_states, exact_percentiles, value_states
from methloom.llm.spectral import cell_pairs, cell_table, group_summary, purified, spectral_groups


def reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = [
    "", None, " ", "Hello  world!!\n\n  def f(x):\n\treturn x", "naïve café – 日本語のテキスト 🙂👩‍👩‍👧", "<|endoftext|> don't we'll I'VE", "a" * 3000,
    "​­ zero", "1234567890 ٣٤٥ x²", "\r\n\r\n \t ", "ab" * 700 + " tail", "\x00\x01 bytes",
]


def test_perfect_hash_is_minimal_and_perfect():
    import xxhash

    keys = [str(i).encode() for i in range(5000)]
    p = PerfectHash(keys)
    got = p.find(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
    assert got.tolist() == list(range(5000))


def test_encoding_equals_public_library(spark):
    enc = reference_encoder()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (enc(t) if t else []), repr(t)
    assert got[None] == enc("null id")
    assert encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_random_bytes_merge_like_public_library():
    enc, own, rnd = reference_encoder(), encoder(), random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice("aeiou thnrs'é漢\n .,;x9") for _ in range(rnd.randint(1, 60)))
        assert own.encode(s) == enc(s)


def test_batches_beyond_the_memo_are_encoded_whole(monkeypatch):
    import base64

    from methloom.llm import bpe

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        own = bpe.Encoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})
    monkeypatch.setattr(bpe, "MEMO", 50)
    enc = reference_encoder()
    batches = [[f"word{k} of batch {k}, item x{k * i}y" for i in range(30)] + ["", None] for k in range(6)]
    batches.append([f"q{i}z" for i in range(120)])  # more than the memo holds at all
    for texts in batches:
        flat, offsets = own.encode_batch(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc(t) if t else [] for t in texts]
        for t in filter(None, texts[:3]):
            assert own.encode(t) == enc(t) and own.count(t) == len(enc(t))


def test_pieces(spark):
    enc = reference_encoder()
    rnd = random.Random(4)
    para = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randint(8, 40))) + "."
    long = "\n\n".join(para() for _ in range(60))
    texts = ["short", None, "", long, "z" * 20000, "漢字" * 2000, "word " * 3000, "```\n" + "x = 1\n" * 900 + "```"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, piece int")
    rows = split_long_texts(df, "doc_id", "text").orderBy("doc_id", "piece_no").collect()
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(texts) if t and len(enc(t)) > 512}
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        at = 0
        for k, r in enumerate(mine):
            assert r.piece == t[r.start_char : r.end_char] and r.new_from_char == at and r.end_char > at
            assert r.n_tokens == len(enc(r.piece)) <= 512
            if k:
                assert mine[k - 1].start_char <= r.start_char <= r.new_from_char
                assert len(enc(t[r.start_char : r.new_from_char])) <= 64
            at = r.end_char
        assert not mine or at == len(t)
    # Cuts of the text in paragraphs lie at its own boundaries.
    for r in rows:
        if r.doc_id == 3 and r.end_char < len(long):
            assert long[: r.end_char].endswith((".", "\n\n"))
    # An edit at the front leaves the later cuts where they were.
    cut = Cutter(encoder(), 512, 64, 256)
    one = {len(long) - c[2] for c in cut.cut(long)}
    two = {len(long) - c[2] for c in cut.cut(long)}
    edited = "A new opening sentence. " + long
    moved = {len(edited) - c[2] for c in cut.cut(edited)}
    assert one == two and len(one & moved) >= len(one) // 2
    assert split_long_texts(df.limit(0), "doc_id", "text").collect() == []


def test_piece_sizes_are_those_of_the_piece_alone():
    rnd, enc = random.Random(3), encoder()
    cut = Cutter(enc, 40, 8, 16)
    bits = [" ", "\n", "\n\n", "\t", "  ", "\r\n", "\u00a0", "word", " don't", "x1", "...", "漢字", "!", "\x1c", "\u2028", "```", "- item", "a" * 70]
    for k in range(400):
        text = "".join(rnd.choice(bits[: None if k % 4 == 0 else -1]) for _ in range(rnd.randint(60, 200)))
        for begin, new, end, n in cut.cut(text) or ():
            assert n == enc.count(text[begin:end]) <= 40 and enc.count(text[begin:new]) <= 8


def passage(seed, n=60):
    rnd = random.Random(seed)
    return [f"w{rnd.randint(0, 400)}" if rnd.random() < 0.3 else rnd.choice("kiln meadow lantern harvest cooper toll quarry estuary ferry mill".split()) for _ in range(n)]


def test_words_ignore_dress():
    plain = words("The quick brown fox can't jump over señor Ärger")
    for other in (
        "THE QUICK\r\n> brown fox can’t **jump** over señor Arger", "the qu​ick br­own <b>f</b>ox<br/>can&#39;t j&#117;mp over se&ntilde;or &Auml;rger",
        "# the quick\n# brown fox\n// can't jump\n* over señor ÄRGER", "the\\nquick\\tbrown fox can\\u0027t jump over se\\u00f1or \\u00c4rger", "thе quісk brоwn fоx cаn't jump оvеr señor Ärger",
        "the%20quick%20brown fox can't ｊｕｍｐ over [señor](http://x.y/z) 𝐀rger",
    ):
        assert words(other) == plain, other
    assert words(None) == words("") == words(" ​ ") == []


def brute_leak(doc, p, run=16, stretch=30, one_in=6):
    best = 0
    for d in range(-len(p), len(doc)):
        same = [0 <= d + j < len(doc) and doc[d + j] == p[j] for j in range(len(p))]
        inside = [0 <= d + j < len(doc) for j in range(len(p))]
        n = 0
        for s in same:
            n = n + 1 if s else 0
            best = max(best, n)
        if best >= run:
            return True
        for a in range(len(p)):
            for b in range(a + stretch, len(p) + 1):
                if all(inside[a:b]) and (b - a - sum(same[a:b])) * one_in <= b - a:
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(passage(i))) for i in range(12)] + [(90, None), (91, ""), (92, "too short a passage")]
    docs = []
    for k in range(150):
        p = items[rnd.randrange(12)][1].split()
        a = rnd.randint(0, 25)
        got = p[a : a + rnd.choice([10, 14, 15, 16, 17, 30, 31, 36, 60])]
        every = rnd.choice([0, 0, 4, 5, 6, 7, 9])
        got = [("zzz" if every and j % every == every - 1 else w) for j, w in enumerate(got)]
        docs.append((k, " ".join(passage(1000 + k, rnd.randint(0, 30)) + got + passage(2000 + k, rnd.randint(0, 30)))))
    docs += [(900, None), (901, ""), (902, "x"), (903, docs[0][1]), (903, docs[0][1])]
    corpus = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id int, text string, item int").repartition(3)
    tests = spark.createDataFrame(items, "item_id int, passage string")
    expected = {(d, i) for d, t in docs for i, p in items if p and t and brute_leak(t.split(), p.split())}
    for shard, per in ((50, 5), (1_000_000, 20_000)):
        leaks = find_leaks(corpus, "doc_id", "text", tests, "item_id", "passage", shard_words=shard, items_per_pass=per)
        rows = leaks.collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
    left = without_leaks(corpus, "doc_id", leaks)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert find_leaks(corpus.limit(0), "doc_id", "text", tests, "item_id", "passage").collect() == []
    assert find_leaks(corpus, "doc_id", "text", tests.limit(0), "item_id", "passage").collect() == []


def test_percentiles_exact_and_combinable(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), rnd.choice("xyz"), rnd.choice([None, float("nan"), *map(float, range(40))])) for _ in range(900)] + [("one", "x", 7.0)]
    df = spark.createDataFrame(rows, "g string, day string, n double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    whole = value_states(df, {"g": "g"}, "n")
    days = [value_states(df.where(f"day = '{d}'"), {"g": "g"}, "n") for d in "xyz"]
    merged = combine_states(days[0].unionByName(days[1]).unionByName(days[2]), ["g"])
    for st in (whole, merged):
        got = {(r.g, r.prob): (r.value, r.n) for r in exact_percentiles(st, ["g"], probs, partitions=7).collect()}
        for g in {r[0] for r in rows}:
            vs = np.array([v for a, _, v in rows if a == g and v is not None and v == v])
            for p in probs:
                assert got[g, p][1] == len(vs) and got[g, p][0] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    assert exact_percentiles(whole.limit(0), ["g"], probs).collect() == []


def cells_input(spark, n_groups=25):
    rng = np.random.default_rng(3)
    matrix, qc, rid = [], [], 0
    true = {}
    for g in range(n_groups):
        bits, level = rng.random(64) < 0.5, rng.uniform(0.1, 0.9)
        centre = np.where(bits, rng.uniform(0.75, 0.9, 64), rng.uniform(0.05, 0.2, 64))
        for k in range(int(rng.integers(1, 12))):
            name, row = f"CELL{g:03d}{k:03d}-00", g * 100 + k
            true[name] = g
            for r in range(64):
                if rng.random() > 0.06:
                    rid += 1
                    cell = rng.choice([name, name, name, "", "N/A"]) if r else name
                    matrix.append((rid, "lib", row, r, str(cell), float(np.clip(centre[r] + rng.normal(0, 0.02), 0, 1)) if rng.random() > 0.01 else None))
            qc += [(name, level + 0.002), (name, 100 * (level - 0.002)), (name, None)]
    matrix += [(rid + 1, "lib", 9999, 0, None, 0.5), (rid + 2, "lib", 9998, 0, "LONELYCELL-00", None)]
    m = spark.createDataFrame(matrix + matrix[:40], "row_id int, library_id string, cell_row int, region_idx int, cell_id string, mean_meth double")
    return m, spark.createDataFrame(qc, "cell_id string, mean_meth double"), true


def test_spectral_groups(spark):
    m, qc, true = cells_input(spark)
    groups = spectral_groups(cell_table(m, qc)).cache()
    pairs = {(r.cell_id_a, r.cell_id_b) for r in cell_pairs(groups).collect()}
    expected = {(a, b) for a in true for b in true if a < b and true[a] == true[b]}
    assert pairs <= expected and len(pairs) >= 0.97 * len(expected)
    summary = group_summary(groups).collect()
    assert sum(r.n_cells for r in summary) == len(true) + 1
    assert all(len(r.typical_cells) == min(3, r.n_cells) for r in summary)
    pure = purified(groups).collect()
    assert sorted(r.cell_id for r in pure) == sorted(r.cell_id for r in groups.collect())
    members = {}
    for r in pure:
        members.setdefault(r.grp, set()).add(true.get(r.cell_id, r.cell_id))
    assert all(len(m) == 1 for m in members.values())
    assert spectral_groups(cell_table(m.limit(0), qc)).collect() == []
