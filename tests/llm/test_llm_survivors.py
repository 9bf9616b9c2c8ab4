"""Near dedup leaves one row of each group, whatever its doc_ids."""

from ledgerlens.llm import minhash


def test_one_row_stays_without_distinct_ids(spark):
    def text(name, last):
        return " ".join(f"{name}{i}" for i in range(60)) + f" {last}"

    rows = [(1, text("a", "x")), (1, text("a", "y")), (2, text("a", "z")),                   # one id, other texts
            (None, text("b", "x")), (None, text("b", "y")), (None, text("b", "y")),          # no id at all
            (None, text("c", "x")), (9, text("c", "y")),                                     # an id before none
            (None, text("d", "x")), (1, text("e", "x")),                                     # alone
            (None, None), (None, " "), (None, " "), (4, ""), (4, None)]                      # linked with nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [("a", 1), ("b", None), ("c", 9), ("d", None), ("e", 1)]
    first = None
    for n in (1, 5):
        got = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(docs.repartition(n)).collect()]
        assert sorted((t[0], i) for i, t in got if t and t.strip()) == want
        blank = sorted((i is None, i or 0) for i, t in got if not (t and t.strip()))
        assert blank == [(False, 4), (True, 0), (True, 0)]
        first = first or sorted((t or "").strip() for _, t in got)
        assert first == sorted((t or "").strip() for _, t in got)
