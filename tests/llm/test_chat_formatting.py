from docloom.llm import chat_formatting as cf

from ..helpers import same_as_sql, tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, conv string"


def chats(spark, rows):
    return {r["conv_id"]: r for r in cf.op7_chat_formatting(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)).collect()}


def test_snapshots_collapse(spark):
    u, a = "user", "assistant"
    rows = [(1, 0, u, "hi"), (2, 0, u, "hi"), (2, 1, a, "yes"), (3, 0, u, "hi"), (3, 1, a, "no"), (4, 0, u, "hi"), (4, 1, a, "yes"), (5, 0, u, "other"), (6, 0, a, "hi"), (7, 5, u, "other")]
    found = chats(spark, rows)
    assert set(found) == {2, 3, 5, 6}
    assert found[2]["n_copies"] == 2 and found[2]["n_turns"] == 2 and found[5]["n_copies"] == 2
    assert found[2]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


def test_odd_turns(spark):
    found = chats(spark, [(None, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "<|im_end|>"), (3, 1, "user", "b"), (3, 1, "assistant", "c"), (4, 0, "user", "x" * 50_000)])
    assert set(found) == {None, 1, 2, 3, 4}
    assert found[1]["chat"] == "<|im_start|>\n<|im_end|>\n"
    assert found[2]["chat"].count("<|im_end|>") == 1
    assert found[3]["chat"].index("assistant") < found[3]["chat"].index("user")
    assert chats(spark, []) == {}


def test_equals_sql(spark, sf_dir):
    same_as_sql(cf.op7_chat_formatting(spark.read.parquet(f"{sf_dir}/conversations.parquet")), tables(sf_dir), cf.OP7_SQL)
