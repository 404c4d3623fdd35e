"""Passages between a "<" and a ">" that are no tag."""

from test_llm import passage

from methloom.llm.leakage import find_leaks


def test_words_after_a_less_than_sign_are_searched(spark):
    p = " ".join(passage(5, 40))
    docs = [(0, f"while i <n and {p}\n> so it ends"), (1, f"i <n and {p} > 3"), (2, p.replace(" ", " <x hidden>", 1).replace(" ", "<br class='y'/> ")), (3, "i <n and nothing\n> else")]
    corpus = spark.createDataFrame(docs, "doc_id int, text string")
    leaks = find_leaks(corpus, "doc_id", "text", spark.createDataFrame([(7, p)], "item_id int, passage string"), "item_id", "passage").collect()
    assert sorted((r.doc_id, r.item_id) for r in leaks) == [(0, 7), (1, 7), (2, 7)]


def test_words_replaced_by_longer_ones(spark):
    """One word in six replaced by one that is written as up to three; one word more, and it is no leak."""
    from methloom.llm.leakage import find_leaks

    p = [f"w{i}" for i in range(48)]
    items = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(f"v{i}" for i in range(90)))], "item int, passage string")

    def doc(a, b, places, by="forty-one"):
        return "x y z " + " ".join(by if i in places else w for i, w in enumerate(p) if a <= i < b) + " z y x"

    docs = [
        (1, doc(0, 30, {4, 10, 16, 20, 25})), (2, doc(0, 30, {4, 10, 16, 20, 25, 28})), (3, doc(10, 40, {11, 17, 23, 30, 36}, "one-two-three")),
        (4, doc(0, 48, set(range(5, 48, 6)))), (5, doc(0, 28, {4, 10, 16, 22})), (6, doc(0, 30, {4, 10, 16, 20, 25}, "a-b-c-d")), (7, doc(0, 17, set())), (8, doc(0, 15, set())),
        (9, doc(0, 30, {2, 3, 4, 5, 15, 22})), (10, "x " + " ".join(w for i, w in enumerate(p[:30]) if i not in (10, 16)) + " y"), (11, None), (12, ""),
    ]
    corpus = spark.createDataFrame(docs, "doc int, text string")
    for shard in (1_000_000, 20):
        got = {r.doc: (r.longest_run, r.longest_stretch) for r in find_leaks(corpus, "doc", "text", items, "item", "passage", shard_words=shard).collect()}
        assert set(got) == {1, 3, 4, 7}
        assert got[1][1] == got[3][1] == 30 and got[4][1] == 48 and got[7] == (17, 0)
