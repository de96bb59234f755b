import io
import shutil
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators.cache import digest
from docloom.plans import jobs
from docloom.sources import chunk_table, files
from docloom.sources import scratch as scratch_tables
from docloom.streaming.ingest import start_upload_stream


def docx(paragraphs, images=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{body}</w:document>')
        for name, content in images:
            archive.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {
        "a.TXT": "é one.\r\nTwo.".encode(), "sub/b.md": "caf\xe9".encode("latin-1"), "c.html": b"<title>T</title><p>A &amp; b<script>x</script></p>", "d.docx": docx(["P1", "P2"], [("word/media/i.PNG", b"img"), ("word/media/x.txt", b"")]),
        "e.odt": b"no archive", "f.exe": b"x", "g.png": b"img",
    }.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_scan_and_load(spark, folder):
    found = files.scan_directory(spark, str(folder))
    assert {r["path"].removeprefix(f"{folder}/"): r["family"] for r in found.collect()} == {"a.TXT": "text", "sub/b.md": "text", "c.html": "document", "d.docx": "document", "e.odt": "document", "g.png": "image"}
    assert files.scan_directory(spark, str(folder), [".MD"]).count() == 1
    rows = files.load_texts(found).collect()
    assert {r["path"].rpartition("/")[2]: r["text"] for r in rows} == {"a.TXT": "é one.\nTwo.", "b.md": "café", "c.html": "T\nA & b", "d.docx": "P1\nP2", "e.odt": None, "g.png": None}
    errors = {r["path"].rpartition("/")[2]: r["error"] for r in rows if r["error"]}
    assert errors["e.odt"].startswith("BadZipFile") and errors["g.png"] == "LookupError: no recognised text of this image"
    known = spark.createDataFrame([(f"{folder}/g.png", "a cat")], "path string, text string")
    assert {r["text"] for r in files.load_texts(found, known).where("path LIKE '%.png'").collect()} == {"a cat"}
    raw = spark.read.format("binaryFile").load(str(folder))
    assert [r["path"].rpartition("/")[2] for r in files.unsupported(raw).collect()] == ["f.exe"]


def test_images_in_office_files(spark, folder):
    office = files.scan_directory(spark, str(folder), [".docx", ".odt"])
    images = files.zip_images(office)
    assert [(r["img_idx"], r["name"]) for r in images.collect()] == [(0, "word/media/i.PNG")]
    said = images.select(digest(F.col("content")).alias("digest"), F.lit("a cat").alias("text"))
    texts = files.with_image_texts(files.office_texts(office), images, said)
    assert {r["text"] for r in texts.collect()} == {"P1\nP2\n\n[embedded image: a cat]", None}
    blank = files.office_texts(office).withColumn("text", F.lit(" "))
    assert {r["text"] for r in files.with_image_texts(blank, images, said).collect()} == {"[embedded image: a cat]", ""}


def test_snapshot_rewrites_only_its_users(spark, tmp_path):
    table, staging = str(tmp_path / "t"), str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "y")], "user_id int, source string, chunk_index int, chunk string")
    chunk_table.write_chunks(rows, table)
    own = chunk_table.read_chunks(spark, table, 1)
    assert own.count() == 1 and "PartitionFilters: [isnotnull(user_id" in own._jdf.queryExecution().toString()
    chunk_table.write_snapshot(own.withColumn("chunk", F.lit("z")), table, staging)
    assert {(r["user_id"], r["chunk"]) for r in chunk_table.read_chunks(spark, table).collect()} == {(1, "z"), (2, "y")}


def test_uploads_are_indexed_once(spark, folder, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("stored")
    table, state = str(tmp_path / "table"), str(tmp_path / "state")

    def index():
        start_upload_stream(spark, str(folder), table, state, 7, once=True).awaitTermination()
        return sorted((r["user_id"], r["source"].partition("_")[0], r["chunk_index"], r["chunk"]) for r in chunk_table.read_chunks(spark, table).collect())

    def pending():
        return sorted((r["source"].partition("_")[0], r["error"].partition(":")[0]) for r in spark.read.parquet(f"{table}-pending").collect())

    first = index()
    assert first == [(7, "a", 0, "é one. Two."), (7, "b", 0, "café"), (7, "c", 0, "T A & b"), (7, "d", 0, "P1 P2")]
    waiting = [("e", "BadZipFile"), ("f", "ValueError"), ("g", "LookupError")]
    assert pending() == waiting and index() == first and pending() == waiting
    (folder / "late.txt").write_text("Late.")
    assert len(index()) == 5
    shutil.rmtree(state)  # every batch comes again
    assert len(index()) == 5 and pending() == waiting


def test_a_large_user_has_many_files_and_a_small_one_a_single_one(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CAST(IF(id < 990, 1, 2) AS INT) AS user_id", "CAST(id AS STRING) AS source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chunk_table.spread(rows, 100).write.partitionBy("user_id").parquet(str(tmp_path / "t"))
    count = {u: len(list((tmp_path / "t" / f"user_id={u}").glob("*.parquet"))) for u in (1, 2)}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert count[2] == 1 and count[1] > 2


def test_spreading_brings_no_user_to_one_task(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 2 AS INT) AS user_id", "CAST(id AS STRING) AS source")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = chunk_table.spread(rows, 100)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_directory_is_indexed_once(spark, folder, tmp_path_factory):
    """Two runs over an unchanged directory: the second changes nothing and sends nothing to the model."""
    tmp_path = tmp_path_factory.mktemp("stored")
    table, cache, calls = str(tmp_path / "table"), str(tmp_path / "cache"), tmp_path / "calls"
    calls.mkdir()

    def model(texts):
        for text in texts:
            (calls / uuid.uuid4().hex).write_text(text)
        return [[1.0, 2.0]] * len(texts)

    def index():
        done = jobs.index_directory(spark, str(folder), table, cache, model, 3)
        statuses = {r["source"].rpartition("/")[2]: r["status"] for r in done.classified.collect()}
        failed = {r["source"].rpartition("/")[2] for r in done.failed.collect()}
        return statuses, failed, sorted((r["source"].rpartition("/")[2], r["chunk"], r["embedding"]) for r in done.chunks.collect())

    statuses, failed, rows = index()
    assert set(statuses.values()) == {"new"} and failed == {"e.odt", "g.png"}
    assert [r[:2] for r in rows] == [("a.TXT", "é one. Two."), ("b.md", "café"), ("c.html", "T A & b"), ("d.docx", "P1 P2")] and all(r[2] == [1.0, 2.0] for r in rows)
    assert sorted(f.read_text() for f in calls.iterdir()) == sorted(r[1] for r in rows)
    again = index()
    assert {k for k, v in again[0].items() if v == "unchanged"} == set(statuses) - failed and again[2] == rows and len(list(calls.iterdir())) == 4
    (folder / "a.TXT").write_text("Other text.")
    (folder / "sub" / "b.md").unlink()
    statuses, failed, rows = index()
    assert (statuses["a.TXT"], statuses["b.md"]) == ("modified", "deleted") and [r[1] for r in rows] == ["Other text.", "T A & b", "P1 P2"] and len(list(calls.iterdir())) == 5
    only = jobs.index_directory(spark, str(folder), table, cache, model, 3, extensions=[".txt"])
    assert {r["status"] for r in only.classified.collect()} == {"unchanged"} and only.chunks.count() == 3
    for name in ("a.TXT", "c.html", "d.docx"):
        (folder / name).unlink()
    assert index()[2] == []


def test_a_directory_run_leaves_no_scratch_copy_of_the_texts_and_a_repeated_one_writes_no_snapshot(spark, tmp_path, monkeypatch):
    (tmp_path / "files").mkdir()
    for k in range(3):
        (tmp_path / "files" / f"f{k}.txt").write_text(f"A sentence of file {k}. Another one.")
    scratch, staged, kept = tmp_path / "scratch", [], jobs.chunk_table.write_snapshot
    scratch.mkdir()
    monkeypatch.setattr(scratch_tables, "shared_dir", lambda spark: str(scratch))
    monkeypatch.setattr(jobs.chunk_table, "write_snapshot", lambda *a, **b: (staged.append(1), kept(*a, **b)))
    for run in range(2):
        done = jobs.index_directory(spark, str(tmp_path / "files"), str(tmp_path / "table"), str(tmp_path / "cache"), lambda texts: [[1.0] for _ in texts], 0)
        assert done.chunks.select("source").distinct().count() == 3 and done.cache.count() == 3 and done.failed.isEmpty()
        assert {r["status"] for r in done.classified.collect()} == {"unchanged" if run else "new"}
    assert {p.name.split("-")[1] for p in scratch.iterdir()} <= {"listing", "classified", "failed", "unread"} and len(staged) == 1
