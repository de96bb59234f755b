import hashlib
import random
import re
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import fingerprints as fp


def canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())).strip()


def expected(rows):
    """Rows by descending id (null last), each with what it must give; ids are unique."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        same = [float(canonical(text) == canonical(x)) for x in (edited, after)]
        yield i, (len(text), hashlib.sha256(edited.encode()).hexdigest(), *same), canonical(text), canonical(edited)


def check(frame, rows):
    out = {r["doc_id"]: r for r in fp.op9_fingerprints(frame).collect()}
    assert len(out) == len(rows)
    prints = {}
    for i, values, text, edited in expected(rows):
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == values
        for name, canon in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert r[name].startswith(f"{xxhash.xxh64_intdigest(canon.encode(), 42):016x}")
            assert prints.setdefault(canon, r[name]) == r[name]
    assert len(set(prints.values())) == len(prints)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("partitions", [1, 5])
def test_texts_of_all_kinds(frame, partitions):
    rng = random.Random(1)
    texts = [None, "", "A", "a ", "é X", "É x", "😀😀b", "   ", "z" * 40_000, "same", "SAME", "same\n", "Straße", "STRASSE", "ὈΔΥΣΣΕΎΣ", "ὀδυσσεύς", "ὀδυσσεύσ"]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "last")] + [(1000 + i, "".join(rng.choice("aB é") for _ in range(rng.randrange(30)))) for i in range(150)]
    check(frame(rows).repartition(partitions), rows)


def test_case_is_folded(frame):
    rows = [(1, "Straße"), (2, "STRASSE"), (3, "ὈΔΥΣΣΕΎΣ"), (4, "ὀδυσσεύς"), (5, "E\u0301t\u00e9"), (6, "\u00c9T\u00c9")]
    out = {r["doc_id"]: r["fingerprint"] for r in fp.op9_fingerprints(frame(rows)).collect()}
    assert out[1] == out[2] and out[3] == out[4] and out[5] == out[6] and len(set(out.values())) == 3


def test_many_null_ids_are_dealt_into_ranges(spark, frame, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    rows = [(None, f"text number {i}") for i in range(120)] + [(i, f"other {i}") for i in range(60)]
    paired = fp.with_next(frame(rows).select("doc_id", "text"), "text").where("NOT copy")
    assert paired.where("id IS NULL").select("bucket").distinct().count() > 5
    found = {r["value"]: r["following"] for r in paired.collect()}
    null_order = [r["text"] for r in frame(rows).where("doc_id IS NULL").orderBy(F.desc(F.xxhash64("text"))).collect()]
    order = [f"other {i}" for i in range(59, -1, -1)] + null_order
    assert found == dict(zip(order, order[1:] + order[:1], strict=True))


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        fp.op9_fingerprints(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_one_row_and_none(frame, empty, odd):
    check(frame([(1, "abcd")]), [(1, "abcd")])
    assert fp.op9_fingerprints(empty).count() == 0
    out = fp.op9_fingerprints(odd)
    assert out.count() == 14 and out.where("near_edited NOT IN (0, 1) OR near_next NOT IN (0, 1)").count() == 0


def test_equal_hashes_of_different_texts(frame, monkeypatch):
    monkeypatch.setattr(fp, "wide_hash", lambda canon: [F.length(canon).cast("bigint").alias("h1"), F.lit(7).cast("bigint").alias("h2")])
    out = {r["doc_id"]: r for r in fp.op9_fingerprints(frame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")])).collect()}
    assert out[1]["fingerprint"] == out[3]["fingerprint"] != out[2]["fingerprint"]
    assert len({r["fingerprint"] for r in out.values()}) == 3


def test_no_python_in_the_plan(spark, sf_dir):
    plan = fp.op9_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_tasks_grow_in_number_with_the_bytes(spark, frame, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 100)
    monkeypatch.setattr(fp, "TASK_BYTES", 500)
    docs = frame([(i, f"text of document {i} " * 5) for i in range(400)])
    size = sum(len(r["text"]) for r in docs.collect())
    paired = fp.with_next(docs.select("doc_id", "text"), "text")
    assert paired.rdd.getNumPartitions() == -(-size // 500)
    plan = paired._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
