import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import semantic
from docloom.operators.semantic import parse_boundaries


@pytest.mark.parametrize(("words", "want"), [([3, 4, 2, 5], [(0, 1), (2, 3)]), ([9, 1], [(0, 0), (1, 1)]), ([0, 9], [(0, 1)])])
def test_blocks_golden(spark, words, want):
    rows = spark.createDataFrame([(words,)], "words array<int>")
    assert [tuple(b) for b in rows.select(semantic.pack_blocks(F.col("words"), 7)).first()[0]] == want


def test_merge_golden(spark):
    rows = spark.createDataFrame([([50, 180, 300, 90], [(0, i, i, i, f"h{i}") for i in range(4)])], f"words array<int>, bounds {semantic.BOUNDS}")
    merged = rows.select(semantic.merge_small(F.col("bounds"), F.col("words"), 200)).first()[0]
    assert [tuple(b)[2:] for b in merged] == [(0, 1, "h0; h1"), (2, 2, "h2"), (3, 3, "h3")]


def test_documents_without_sentences_have_no_blocks(spark):
    docs = spark.createDataFrame([("a", None), ("b", " "), ("c", "One. Two.")], "k string, text string")
    lists = semantic.sentence_lists(docs, "k")
    assert [tuple(r) for r in semantic.boundary_requests(lists, "k").collect()] == [("c", 0, 0, 2, "[0] One.\n[1] Two.")]
    none = spark.createDataFrame([], "k string, block int, response string")
    assert [tuple(r) for r in semantic.chunk_semantically(docs, none, "k").collect()] == [("c", 0, "Content section", "One. Two.")]


def test_unreadable_replies_fall_back(spark):
    requests = spark.createDataFrame([("d", b, 10, 4, "") for b in range(4)], "k string, block int, offset int, n int, numbered string")
    texts = ['{"chunks": [{"start_sentence": 0, "end_sentence": 1, "header": "x"}, {"start_sentence": 2, "end_sentence": 3}]}', "no", '{"chunks": [{"start_sentence": null}]}']
    replies = spark.createDataFrame([("d", b, x) for b, x in enumerate(texts)], "k string, block int, response string")
    out = sorted((x["block"], x["pos"], x["start"], x["end"], x["header"]) for x in parse_boundaries(requests, replies, "k").collect())
    assert out == [(0, 0, 10, 11, "x"), (0, 1, 12, 13, ""), *[(b, 0, 10, 13, "Content section") for b in (1, 2, 3)]]


def test_long_documents_take_time_in_proportion():
    def seconds(n):
        began = time.perf_counter()
        assert len(semantic.packed_ranges([3] * n, 5)) == n
        assert len(semantic.merged_ranges(list(range(n)), list(range(n)), [3] * n, 2)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(400_000) for _ in range(3)) < 6 * min(seconds(200_000) for _ in range(3))


@pytest.mark.parametrize(
    ("starts", "ends", "least", "want"),
    [([0, 2], [1, 3], 0, [(0, 0), (1, 1)]), ([0, 9], [1, 12], 1, [(0, 0), (1, 1)]), ([5, 6, 0], [3, 9, 1], 1, [(0, 2)]), ([-3, 1], [0, 3], 11, [(0, 1)]), ([], [], 5, [])],
)
def test_merged_ranges_of_odd_boundaries(starts, ends, least, want):
    """Boundaries beyond the sentences and those that end before they start have no words."""
    assert semantic.merged_ranges(starts, ends, [10, 10, 10, 10], least) == want


def test_null_lists_stay_null(spark):
    rows = spark.createDataFrame([(None,), ([4],)], "words array<int>")
    found = [r[0] for r in rows.select(semantic.pack_blocks(F.col("words"), 7)).collect()]
    assert found[0] is None and [tuple(b) for b in found[1]] == [(0, 0)]
