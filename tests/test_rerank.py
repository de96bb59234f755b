import pytest

from docloom.operators import rerank as r
from docloom.operators.context import prompts


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(q, k + 1, f"c{k}") for q in range(1, 8) for k in range(5)], "query_id bigint, rank int, chunk string")


REPLIES = {1: '{"indices": [0, 2, 2, 9, -1, 4, 1]}', 2: '{"indices": []}', 3: '{"indices": [1], "rejected": true}', 4: "[7,9", 5: '```json\n{"indices": ["3", 1]}\n```', 6: '{"indices": [7, 9]}'}


def test_replies_golden(spark, five):
    replies = spark.createDataFrame(list(REPLIES.items()), "query_id bigint, response string")

    def order(policy):
        out = {}
        for row in r.apply_rerank(five, replies, top_k=3, on_reject=policy).orderBy("query_id", "place").collect():
            out.setdefault(row["query_id"], []).append(row["chunk"])
        return out

    first = ["c0", "c1", "c2"]
    assert order("fallback") == {1: ["c0", "c2", "c4"], 2: first, 3: first, 4: first, 5: ["c3", "c1"], 6: first, 7: first}
    assert order("empty") == {1: ["c0", "c2", "c4"], 4: first, 5: ["c3", "c1"], 7: first}
    asked = spark.createDataFrame([(q,) for q in range(1, 9)], "query_id bigint")
    assert {x[0] for x in r.rejected_queries(asked, five, replies).where("rejected").collect()} == {2, 3, 6, 8}
    assert r.apply_rerank(five, replies, use=False).count() == 35


def test_prompts_hold_questions_with_braces(spark):
    asked = spark.createDataFrame([(1, "a {context} b")], "query_id bigint, question string")
    contexts = spark.createDataFrame([(1, "C", 1)], "query_id bigint, context string, n_chunks bigint")
    flags = spark.createDataFrame([(1, False)], "query_id bigint, low_confidence boolean")
    assert prompts(asked, contexts, flags, "{notice}<{context}|{question}>").first()["prompt"] == "<C|a {context} b>"
