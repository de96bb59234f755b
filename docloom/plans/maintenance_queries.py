"""Queries over tables that are kept up to date in place: bucketed chunks, a bucketed cache, catalogue totals; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import cache, catalog_deltas, retrieval
from docloom.plans.corpora import LINES_SQL, VECTORS_SQL, files, line_chunks, questions, vectors
from docloom.sources import vector_index
from docloom.sources.bucketed_cache import BucketedCache
from docloom.sources.bucketed_chunks import BucketedChunks
from docloom.sources.scratch import materialise, new_path

COLUMNS = "user_id int, source string, file_type string, chunk_index int, content_hash string, file_mtime timestamp_ntz, chunk string"
NAMES = [part.split(" ")[0] for part in COLUMNS.split(", ")]


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk with another hash for one file in ninety-seven."""
    rows = files(spark, sf_dir).where("doc_id % 97 = 5").withColumns({"chunk_index": F.lit(0), "chunk": F.lit("changed"), "content_hash": F.lit("1" * 16)})
    return rows.select(*NAMES)


def bucketed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table in buckets of about 2,000 rows in which one file in ninety-seven changes and another goes: rows, files and characters by user, rows rewritten and partitions kept."""
    table = BucketedChunks(spark, new_path(spark, "bucketed"), 2000, COLUMNS)
    table.append(line_chunks(spark, sf_dir).select(*NAMES))
    gone = files(spark, sf_dir).where("doc_id % 97 = 11").select("user_id", "source")
    report = table.update(_changed(spark, sf_dir), gone=gone)
    rows = table.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("source").alias("n_files"), F.sum(F.length("chunk")).alias("n_chars"), F.count_distinct("bucket").alias("n_partitions"))
    rewritten = report.groupBy("user_id").agg(F.sum("n_rows").alias("n_rewritten"))
    return rows.join(rewritten, "user_id", "left").withColumn("n_rewritten", F.coalesce("n_rewritten", F.lit(0)))


def bucketed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines looked up in a bucketed cache that grows twice, and is compacted: hits, misses and known lengths by document."""
    rows = cache.with_digest(line_chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk"), "chunk")
    known = BucketedCache(spark, new_path(spark, "bucketed-cache"), "size int", int(spark.conf.get("spark.sql.shuffle.partitions")))
    for part in ("doc_id % 2 = 0", "doc_id % 3 = 0"):
        known.add(known.misses(rows.where(part), "chunk").select("digest", F.length("chunk").alias("size")))
    known.compact()
    return known.look_up(rows).groupBy("doc_id").agg(F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"), F.coalesce(F.sum("size"), F.lit(0)).alias("known_chars"))


def catalog_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by user and type after three runs of changes (files added, changed and gone) from those of the first third: never counted over all chunks again. The sketch's estimate is within a tenth."""
    lines = line_chunks(spark, sf_dir).select("doc_id", *NAMES)
    none = lines.limit(0)
    totals = catalog_deltas.totals_of(lines.where("doc_id % 3 = 0"))
    shorter = lines.where("doc_id % 3 = 0 AND doc_id % 7 = 0")
    runs = [(none, lines.where("doc_id % 3 = 1")), (shorter, shorter.where("chunk_index = 0")), (lines.where("doc_id % 3 = 1 AND doc_id % 5 = 0"), lines.where("doc_id % 3 = 2"))]
    for before, after in runs:
        totals = materialise(catalog_deltas.merged(totals, catalog_deltas.file_changes(before, after)), "totals")
    seen = F.col("n_files") + F.col("n_gone")
    report = catalog_deltas.type_report(totals).join(totals.select("user_id", F.coalesce("file_type", F.lit("unknown")).alias("file_type"), seen.alias("seen")), ["user_id", "file_type"])
    return report.select("user_id", "file_type", "n_chunks", "n_files", (F.abs(F.col("about") - F.col("seen")) <= F.greatest(F.lit(2), F.col("seen") / 10)).alias("about_right"))


def stored_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written to disk and searched by every question, against the exact search: how many candidates there are, and whether nine in ten are found."""
    where = new_path(spark, "vector-index")
    chunks, asked = vectors(spark, sf_dir), questions(spark, sf_dir)
    vector_index.write_index(chunks, where, 64)
    found = vector_index.search_index(spark, where, asked, skip_self=True)
    report = vector_index.recall(retrieval.top_k(chunks, asked, skip_self=True), found)
    return report.select("n_questions", "n_exact", (F.col("recall") >= 0.9).alias("recalled"))


BUCKET_SQL = "('0x' || left(sha256(source), 8))::BIGINT % n"
QUERIES = {f.__name__: f for f in (bucketed_replace, bucketed_cache, catalog_runs, stored_index_recall)}
SQL = {
    "bucketed_replace": f"""WITH {LINES_SQL}, sized AS (SELECT user_id, ceil(count(*) / 2000.0)::BIGINT AS n FROM chunks GROUP BY user_id),
old AS (SELECT c.*, {BUCKET_SQL} AS bucket FROM chunks c JOIN sized USING (user_id)),
touched AS (SELECT DISTINCT user_id, bucket FROM old WHERE doc_id % 97 IN (5, 11)),
now AS (SELECT user_id, source, bucket, length(chunk) AS size FROM old WHERE doc_id % 97 NOT IN (5, 11) UNION ALL SELECT DISTINCT user_id, source, bucket, 7 FROM old WHERE doc_id % 97 = 5),
done AS (SELECT user_id, count(*) AS n FROM now JOIN touched USING (user_id, bucket) GROUP BY user_id)
SELECT w.user_id, count(*) AS n_chunks, count(DISTINCT source) AS n_files, sum(size)::BIGINT AS n_chars, count(DISTINCT bucket) AS n_partitions, coalesce(any_value(d.n), 0) AS n_rewritten FROM now w LEFT JOIN done d USING (user_id) GROUP BY w.user_id""",
    "bucketed_cache": f"""WITH {LINES_SQL}, known AS (SELECT DISTINCT chunk FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT doc_id, count(k.chunk) AS n_hits, count(*) - count(k.chunk) AS n_misses, coalesce(sum(length(k.chunk)), 0)::BIGINT AS known_chars FROM chunks c LEFT JOIN known k USING (chunk) GROUP BY doc_id""",
    "stored_index_recall": f"WITH {VECTORS_SQL} SELECT count(DISTINCT query_id) AS n_questions, count(*) AS n_exact, TRUE AS recalled FROM cand",
    "catalog_runs": f"""WITH {LINES_SQL}, now AS (SELECT * FROM chunks WHERE doc_id % 3 = 2 OR (doc_id % 3 = 1 AND doc_id % 5 <> 0) OR (doc_id % 3 = 0 AND (doc_id % 7 <> 0 OR chunk_index = 0)))
SELECT user_id, coalesce(file_type, 'unknown') AS file_type, count(*) AS n_chunks, count(DISTINCT source) AS n_files, TRUE AS about_right FROM now GROUP BY ALL""",
}
