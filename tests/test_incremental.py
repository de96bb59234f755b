import datetime
import os
import uuid

from docloom.operators import cache, catalog, embedding
from docloom.operators import incremental as inc
from docloom.plans import jobs
from docloom.plans.jobs import ingest
from docloom.schemas import CHUNKS

TIME = datetime.datetime(2024, 1, 1)
FILE = "user_id int, source string, file_type string, content_hash string, file_mtime timestamp_ntz, text string"


def stored(spark, rows):
    return spark.createDataFrame([(i, u, c, None, None, s, k, t, h, TIME) for i, (u, s, k, c, t, h) in enumerate(rows)], CHUNKS).drop("id")


def test_change_detection_golden(spark):
    now = spark.createDataFrame([(1, "a", "h1", TIME), (1, "b", "h2", TIME), (1, "c", "h3", TIME)], "user_id int, source string, content_hash string, mtime timestamp_ntz")
    old = spark.createDataFrame([(1, "b", "h2"), (1, "c", "hX"), (1, "d", "h4"), (2, "a", "h1")], "user_id int, source string, content_hash string")
    found = {(x["user_id"], x["source"]): x["status"] for x in inc.classify(now, old).collect()}
    assert found == {(1, "a"): "new", (1, "b"): "unchanged", (1, "c"): "modified", (1, "d"): "deleted", (2, "a"): "deleted"}


def run(spark, files, chunks, model=None, **options):
    none = spark.createDataFrame([], "digest string, embedding array<float>")
    done = ingest(spark.createDataFrame(files, FILE), chunks, none, model or embedding.hashing_model(8), **options)
    rows = sorted((x["user_id"], x["source"], x["chunk"], x["content_hash"]) for x in done.chunks.collect())
    return rows, done


def test_ingest_twice_changes_nothing(spark):
    files = [(1, "a.txt", ".txt", "h1", TIME, "One. Two."), (2, "a.txt", ".txt", "h9", TIME, "Other."), (1, "b.pdf", ".pdf", "h2", TIME, "Three.")]
    rows, done = run(spark, files, stored(spark, []))
    assert rows == [(1, "a.txt", "One. Two.", "h1"), (1, "b.pdf", "Three.", "h2"), (2, "a.txt", "Other.", "h9")]
    again, second = run(spark, files, spark.createDataFrame(done.chunks.collect(), done.chunks.schema))
    assert again == rows
    assert {x["status"] for x in second.classified.collect()} == {"unchanged"}


def test_replacement_and_failure(spark):
    old = stored(spark, [(1, "a", 0, "old", ".txt", "h0"), (1, "a", 1, "no hash", ".txt", None), (1, "gone", 0, "x", ".txt", "h"), (1, "empty", 0, "y", ".txt", "h")])
    files = [(1, "a", ".txt", "h1", TIME, "New."), (1, "empty", ".txt", "h2", TIME, " ")]
    rows, _ = run(spark, files, old)
    assert rows == [(1, "a", "New.", "h1"), (1, "a", "no hash", None)]

    def failing(texts):
        raise OSError("down")

    import docloom.operators.embedding as e

    kept = e.with_retries
    e.with_retries = lambda call, retries: call()
    try:
        rows, done = run(spark, [(1, "a", ".txt", "h1", TIME, "New."), (1, "gone", ".txt", "h", TIME, "x")], old.where("source <> 'empty'"), failing)
        assert {r[2] for r in rows} == {"old", "no hash", "x"}
        assert [tuple(x) for x in done.failed.collect()] == [(1, "a", "OSError: down")]
    finally:
        e.with_retries = kept


def test_a_flaky_model_sees_each_text_once_and_old_rows_stay(spark, tmp_path, monkeypatch):
    """The model answers every second call only: whatever it failed on keeps its old rows, whatever is new has vectors."""
    monkeypatch.setattr(embedding, "with_retries", lambda call, retries: call())
    calls = str(tmp_path)

    def model(texts):
        n = len(os.listdir(calls))
        with open(f"{calls}/{n}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        if n % 2:
            raise OSError("down")
        return [[1.0]] * len(texts)

    old = stored(spark, [(1, f"f{i}", 0, "x", ".txt", "old") for i in range(8)])
    files = spark.createDataFrame([(1, f"f{i}", ".txt", f"h{i}", TIME, f"Text {i}.") for i in range(8)], "user_id int, source string, file_type string, content_hash string, file_mtime timestamp_ntz, text string")
    none = spark.createDataFrame([], "digest string, embedding array<float>")
    done = jobs.ingest(files.repartition(4), old, none, model)
    failed = {r["source"] for r in done.failed.collect()}
    rows = {r["source"]: r for r in done.chunks.collect()}
    assert set(rows) == {f"f{i}" for i in range(8)}
    assert all(r["content_hash"] == "old" if s in failed else r["embedding"] is not None and r["content_hash"] != "old" for s, r in rows.items())
    assert done.cache.count() == 8 - len(failed)
    sent = [line for name in os.listdir(calls) for line in open(f"{calls}/{name}").read().split("\n")]
    assert sorted(sent) == [f"Text {i}." for i in range(8)]


def test_cache_write_back_and_clear(spark):
    known = spark.createDataFrame([("a", "1")], "digest string, value string")
    made = spark.createDataFrame([("a", "2"), ("b", "3")], "digest string, value string")
    assert sorted(map(tuple, cache.write_back(known, made).collect())) == [("a", "1"), ("b", "3")]
    assert cache.clear(known).count() == 0


def test_questions_are_embedded_once_each(spark):
    rows = spark.createDataFrame([(1, 1, "why"), (2, 1, "why"), (3, 2, "how")], "query_id bigint, user_id int, question string")
    out = {r["query_id"]: r["embedding"] for r in embedding.embed_questions(rows, embedding.hashing_model(8)).collect()}
    assert out[1] == out[2] != out[3] and len(out[3]) == 8


def test_scope_protects_other_folders(spark):
    old = stored(spark, [(1, "A/x", 0, "x", ".txt", "h"), (1, "B/y", 0, "y", ".txt", "h")])
    files = [(1, "B/z", ".txt", "h1", TIME, "Z.")]
    assert {r[1] for r in run(spark, files, old)[0]} == {"B/z"}
    assert {r[1] for r in run(spark, files, old, scope="B/")[0]} == {"A/x", "B/z"}


def test_wrong_vector_count_is_an_error(spark):
    texts = spark.createDataFrame([("d1", "a"), ("d2", "b")], "digest string, content string").coalesce(1)
    out = embedding.embed_distinct(texts, lambda t: [[1.0]], retries=0).collect()
    assert [x["embedding"] for x in out] == [None, None] and out[0]["error"].startswith("ValueError")
    assert embedding.embed_distinct(texts, lambda t: [[1.0]], retries=0, zero_fill=2).first()["embedding"] == [0.0, 0.0]


def test_users(spark):
    users = spark.createDataFrame([(5, "x", "k1")], "id bigint, name string, api_key string")
    new = spark.createDataFrame([("y", "k1"), ("z", "k2"), ("w", "k3"), ("w", "k3")], "name string, api_key string")
    out = sorted((x["api_key"], x["name"], x["id"]) for x in inc.upsert_users(users, new).collect())
    assert out[0] == ("k1", "x", 5) and [x[0] for x in out] == ["k1", "k2", "k3"] and {x[2] for x in out} == {5, 6, 7}
    assert inc.cascade_delete(stored(spark, [(5, "a", 0, "x", None, "h"), (6, "a", 0, "x", None, "h")]), users).count() == 1


def test_statistics_golden(spark):
    rows = stored(spark, [(1, "f.pdf", 0, "x", ".pdf", "h"), (1, "f.pdf", 1, "y", None, "h")])
    assert tuple(catalog.index_stats(rows).first()) == (1, 2, 2)
    assert tuple(catalog.path_types(rows).first()) == (1, ".pdf", 1)
    types = spark.createDataFrame([(1, None), (1, "unknown")], "user_id int, file_type string")
    documents = catalog.list_documents(rows.drop("file_type").crossJoin(types.select("file_type")))
    assert sorted(x["chunk_count"] for x in documents.collect()) == [2, 2]
