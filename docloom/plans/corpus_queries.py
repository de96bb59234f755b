"""Queries over files and stored chunks and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.chunking import chunk_documents
from docloom.operators import cache, catalog, embedding, incremental, pages
from docloom.plans.corpora import FILES_SQL, LETTERS_SQL, LINES_SQL, files, letter_model, letter_weight, line_chunks
from docloom.plans.jobs import chunk_files, ingest
from docloom.plans.text_queries import LOOSE_SQL, bounded_sql, loose_sql
from docloom.schemas import VECTORS

Frame = DataFrame


def _current(spark: SparkSession, sf_dir: str) -> Frame:
    """Files on disk now: all but every eleventh."""
    return files(spark, sf_dir).where("doc_id % 11 <> 0").withColumn("mtime", F.col("file_mtime"))


def _stored(spark: SparkSession, sf_dir: str) -> Frame:
    """Stored chunks: all but those of every tenth file, with another hash for every seventh."""
    rows = line_chunks(spark, sf_dir).where("doc_id % 10 <> 0")
    return rows.withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "0000000000000000").otherwise(F.col("content_hash")))


STORED_SQL = (
    LINES_SQL
    + """,
stored AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN '0000000000000000' ELSE content_hash END AS content_hash) FROM chunks WHERE doc_id % 10 <> 0),
old AS (SELECT user_id, source, max(content_hash) AS stored FROM stored GROUP BY user_id, source),
cur AS (SELECT user_id, source, content_hash FROM files WHERE doc_id % 11 <> 0),
status AS (SELECT user_id, source, coalesce(content_hash, stored) AS content_hash,
                  CASE WHEN content_hash IS NULL THEN 'deleted' WHEN stored IS NULL THEN 'new' WHEN stored <> content_hash THEN 'modified' ELSE 'unchanged' END AS status
           FROM cur FULL JOIN old USING (user_id, source))"""
)


def _classified(spark: SparkSession, sf_dir: str) -> Frame:
    return incremental.classify(_current(spark, sf_dir), incremental.existing_files(_stored(spark, sf_dir)))


def list_documents(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.list_documents(line_chunks(spark, sf_dir))


def index_stats(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.index_stats(line_chunks(spark, sf_dir))


def stored_types(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.file_types(line_chunks(spark, sf_dir))


def approximate_types(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.approximate_file_types(line_chunks(spark, sf_dir))


def indexed_files(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.indexed_files(line_chunks(spark, sf_dir))


def corpus_totals(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.corpus_totals(line_chunks(spark, sf_dir))


def file_type_counts(spark: SparkSession, sf_dir: str) -> Frame:
    return catalog.path_types(line_chunks(spark, sf_dir))


def existing_files(spark: SparkSession, sf_dir: str) -> Frame:
    return incremental.existing_files(_stored(spark, sf_dir))


def change_detection(spark: SparkSession, sf_dir: str) -> Frame:
    return _classified(spark, sf_dir).select("user_id", "source", "content_hash", "status")


def files_to_process(spark: SparkSession, sf_dir: str) -> Frame:
    return incremental.to_process(_classified(spark, sf_dir)).select("user_id", "source", "content_hash", "status")


def change_summary(spark: SparkSession, sf_dir: str) -> Frame:
    return incremental.summary(_classified(spark, sf_dir))


def replace_modified(spark: SparkSession, sf_dir: str) -> Frame:
    """The table after modified files were chunked anew: one chunk per file here."""
    work = _classified(spark, sf_dir).where("status = 'modified'").select("user_id", "source")
    fresh = files(spark, sf_dir).join(work, ["user_id", "source"], "left_semi").withColumn("chunk_index", F.lit(0)).withColumn("chunk", F.col("text"))
    columns = ["user_id", "source", "chunk_index", "content_hash", "chunk"]
    out = incremental.replace_modified(_stored(spark, sf_dir).select(*columns), fresh.select(*columns))
    return out.select("user_id", "source", "chunk_index", "content_hash", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def delete_sources(spark: SparkSession, sf_dir: str) -> Frame:
    gone = incremental.to_delete(_classified(spark, sf_dir))
    return incremental.delete_sources(_stored(spark, sf_dir), gone).groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"))


def deletion_report(spark: SparkSession, sf_dir: str) -> Frame:
    """Every third file is asked to go, stored or not."""
    return incremental.deletion_report(_stored(spark, sf_dir), files(spark, sf_dir).where("doc_id % 3 = 0"))


def append_run(spark: SparkSession, sf_dir: str) -> Frame:
    """All current files stored once more, whatever is there."""
    rows = incremental.append_all(_stored(spark, sf_dir).drop("doc_id"), line_chunks(spark, sf_dir).where("doc_id % 11 <> 0").drop("doc_id", "header"))
    return rows.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("n_hashes"), F.max("chunk_index").cast("bigint").alias("last_index"))


def failed_sources(spark: SparkSession, sf_dir: str) -> Frame:
    """Chunks with a control line count as failed; their files store nothing."""
    rows = line_chunks(spark, sf_dir).withColumn("error", F.when(F.length("chunk") > 2000, F.lit("ValueError: line too long")))
    good, failed = incremental.complete_sources(rows)
    counts = good.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("error"))
    return counts.unionByName(failed.select("user_id", "source", F.lit(0).cast("bigint").alias("n"), "error"))


def _users(spark: SparkSession, sf_dir: str) -> Frame:
    """Customers as users: even ones are known, and all come in again."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("api_key"))


def upsert_users(spark: SparkSession, sf_dir: str) -> Frame:
    """Known users with their ids, new ones with whether their id is a new one."""
    people = _users(spark, sf_dir)
    known = people.where("id % 2 = 0")
    out = incremental.upsert_users(known, people.select("name", "api_key"))
    fresh = F.col("id") > F.lit(known.agg(F.max("id")).first()[0])
    return out.groupBy(fresh.alias("fresh")).agg(F.count(F.lit(1)).alias("n_users"), F.count_distinct("id").alias("n_ids"), F.min("api_key").alias("first_key"), F.max("id").alias("last_id"))


def user_ids(spark: SparkSession, sf_dir: str) -> Frame:
    people = _users(spark, sf_dir)
    return incremental.user_ids(people.where("id % 2 = 0"), people.select("api_key"))


def cascade_delete_users(spark: SparkSession, sf_dir: str) -> Frame:
    """Only users of an existing customer number keep their chunks: 1 to 3 here, for customers count from 1."""
    rows = incremental.cascade_delete(line_chunks(spark, sf_dir), _users(spark, sf_dir))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def cache_split(spark: SparkSession, sf_dir: str) -> Frame:
    """Lines of documents against a cache of those of every second document."""
    rows = cache.with_digest(line_chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk"), "chunk")
    known = rows.where("doc_id % 2 = 0").select("digest").distinct().withColumn("value", F.lit("x"))
    return cache.look_up(rows, known).groupBy("doc_id").agg(F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"))


def cache_misses(spark: SparkSession, sf_dir: str) -> Frame:
    rows = cache.with_digest(line_chunks(spark, sf_dir).select("doc_id", "chunk"), "chunk")
    known = rows.where("doc_id % 2 = 0").select("digest").distinct()
    return cache.misses(rows, known, "chunk").select("digest", F.length("chunk").alias("n_chars"))


def cache_growth(spark: SparkSession, sf_dir: str) -> Frame:
    """The cache after the missing lines were written back: known keys keep their value."""
    rows = cache.with_digest(line_chunks(spark, sf_dir).select("doc_id", "chunk"), "chunk")
    known = rows.where("doc_id % 2 = 0").select("digest", F.lit("known").alias("value")).distinct()
    made = rows.where("doc_id % 3 = 0").select("digest", F.lit("made").alias("value")).distinct()
    return cache.write_back(known, made)


def cache_hits(spark: SparkSession, sf_dir: str) -> Frame:
    """Counts over all look-ups."""
    rows = cache.with_digest(line_chunks(spark, sf_dir).select("doc_id", "chunk"), "chunk")
    return cache.hit_report(cache.look_up(rows, rows.where("doc_id % 2 = 0").select("digest").distinct().withColumn("value", F.lit("x"))))


def cache_keys(spark: SparkSession, sf_dir: str) -> Frame:
    rows = files(spark, sf_dir)
    text = F.col("text")
    return rows.select("doc_id", cache.cache_key("embedding", text).alias("embedding_key"), cache.chunk_cache_key(text, 500, 100).alias("chunk_key"), cache.chunk_cache_key(text, 500, 100, ("auto", 50)).alias("ocr_key"))


def cache_stats(spark: SparkSession, sf_dir: str) -> Frame:
    rows = files(spark, sf_dir)
    return cache.cache_stats({"chunks": rows.select(F.col("text").alias("value")), "ocr": rows.where("file_type = '.pdf'").select(F.col("text").alias("value"))})


def chunk_distinct(spark: SparkSession, sf_dir: str) -> Frame:
    """Chunk counts of files where each distinct text was chunked once and met by its digest."""
    rows = cache.with_digest(files(spark, sf_dir).select("doc_id", "text"), "text")
    chunks = chunk_documents(cache.distinct_contents(rows, "text"), ["digest"]).groupBy("digest").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))
    return rows.select("doc_id", "digest").join(chunks, "digest").select("doc_id", "n_chunks", "longest")


def embed_new_texts(spark: SparkSession, sf_dir: str) -> Frame:
    """Vectors of the lines of documents; those of every second one come from the cache."""
    rows = line_chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk")
    none = spark.createDataFrame([], VECTORS)
    _, known = embedding.embed_rows(rows.where("doc_id % 2 = 0"), none, letter_model, "chunk")
    out, _ = embedding.embed_rows(rows, known, letter_model, "chunk")
    return out.select("doc_id", "chunk_index", F.size("embedding").alias("dim"), letter_weight("embedding").alias("weight"), "error")


def _pages(spark: SparkSession, sf_dir: str) -> Frame:
    """Documents as pages, five to a file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(F.lit("pdf"), F.floor(F.col("doc_id") / 5).cast("string")).alias("path"), (F.col("doc_id") % 5).cast("int").alias("page_num"), F.trim("text").alias("text"))


def _images(spark: SparkSession, sf_dir: str) -> tuple[Frame, Frame, Frame]:
    """Page images, embedded images (one or two a page) and what a model said about two thirds of them."""
    rows = _pages(spark, sf_dir)
    whole = rows.select("path", "page_num", F.concat(F.lit("scan "), (F.col("doc_id") % 97).cast("string")).cast("binary").alias("content"))
    count = (F.col("doc_id") % 2 + 1).cast("int")
    part = rows.select("path", "page_num", "doc_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("img_idx"))
    embedded = part.select("path", "page_num", "img_idx", F.concat(F.lit("figure "), ((F.col("doc_id") + F.col("img_idx")) % 89).cast("string")).cast("binary").alias("content"))
    every = whole.select("content", F.lit(pages.STRICT).alias("prompt")).unionByName(embedded.select("content", F.lit(pages.RELAXED).alias("prompt"))).distinct()
    said = every.where(F.length("content") % 3 != 0).select(pages.vision_digest(F.col("content"), F.col("prompt")).alias("digest"), F.concat(F.lit("text of "), F.col("content").cast("string")).alias("text"))
    return whole, embedded, said


def page_route(spark: SparkSession, sf_dir: str) -> Frame:
    return pages.route(_pages(spark, sf_dir)).select("path", "page_num", "strategy")


def page_word_counts(spark: SparkSession, sf_dir: str) -> Frame:
    return pages.page_counts(_pages(spark, sf_dir))


def vision_requests(spark: SparkSession, sf_dir: str) -> Frame:
    whole, embedded, said = _images(spark, sf_dir)
    requests = pages.image_requests(pages.route(_pages(spark, sf_dir)), whole, embedded)
    return pages.vision_requests(requests, said).select("digest", "n_uses", "prompt", F.col("content").cast("string").alias("content"))


def page_assembly(spark: SparkSession, sf_dir: str) -> Frame:
    whole, embedded, said = _images(spark, sf_dir)
    routed = pages.route(_pages(spark, sf_dir))
    texts = pages.assemble_pages(routed, pages.image_requests(routed, whole, embedded), said)
    return texts.select("path", "page_num", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def document_texts(spark: SparkSession, sf_dir: str) -> Frame:
    """Each file's pages joined in the three ways that loaders use."""
    rows = _pages(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")))
    recognised = pages.document_text(rows).withColumnRenamed("text", "a")
    plain = pages.document_text(rows, " ", True).withColumnRenamed("text", "b")
    every = pages.document_text(rows, " ").withColumnRenamed("text", "c")
    joined = recognised.join(plain, "path").join(every, "path")
    return joined.select("path", *[F.md5(F.col(x).cast("binary")).alias(name) for x, name in (("a", "recognised_md5"), ("b", "plain_md5"), ("c", "every_md5"))])


def image_files(spark: SparkSession, sf_dir: str) -> Frame:
    whole, _, said = _images(spark, sf_dir)
    return pages.image_texts(whole.select(F.concat("path", F.lit("/"), F.col("page_num").cast("string"), F.lit(".png")).alias("path"), "content"), said)


def incremental_ingest(spark: SparkSession, sf_dir: str) -> Frame:
    """Chunks per file after an incremental run over the stored table."""
    stored = incremental.chunk_rows(_stored(spark, sf_dir))
    done = ingest(files(spark, sf_dir).where("doc_id % 11 <> 0"), stored, spark.createDataFrame([], VECTORS), letter_model)
    return done.chunks.groupBy("user_id", "source", "content_hash").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("n_vectors"), F.sum(F.coalesce(letter_weight("embedding"), F.lit(0))).alias("weight"))


def chunk_table(spark: SparkSession, sf_dir: str) -> Frame:
    """Chunks of all files, the bounded chunker for PDF and the loose one for the rest."""
    return chunk_files(files(spark, sf_dir)).select("user_id", "source", "file_type", "chunk_index", "chunk")


PAGES_SQL = """page AS (SELECT doc_id, 'pdf' || (doc_id // 5) AS path, (doc_id % 5)::INT AS page_num, trim(text, ' ') AS text FROM documents),
routed AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '\\S+')) < 50 THEN 'strict' ELSE 'relaxed' END AS strategy FROM page),
request AS (SELECT path, page_num, 0 AS img_idx, 'strict' AS prompt, 'scan ' || (doc_id % 97) AS content FROM routed WHERE strategy = 'strict'
            UNION ALL SELECT path, page_num, k, 'relaxed', 'figure ' || ((doc_id + k) % 89) FROM (SELECT *, unnest(range(0, doc_id % 2 + 1)) AS k FROM routed WHERE strategy = 'relaxed')),
said AS (SELECT *, CASE WHEN length(content) % 3 <> 0 THEN 'text of ' || content END AS said FROM request)"""

#: The chunks of all files, as the chunk jobs make them.
CHUNKED_SQL = f"""lt AS (SELECT doc_id, text FROM files WHERE file_type IS DISTINCT FROM '.pdf'), pt AS (SELECT doc_id, text FROM files WHERE file_type = '.pdf'), {loose_sql("lt")}, {bounded_sql("pt")},
made AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk_index, chunk FROM (SELECT * FROM chunk UNION ALL SELECT * FROM bchunk))"""

QUERIES = {
    f.__name__: f
    for f in (
        list_documents, index_stats, stored_types, approximate_types, indexed_files, corpus_totals, file_type_counts, existing_files, change_detection, files_to_process, change_summary, replace_modified,
        delete_sources, deletion_report, append_run, failed_sources, upsert_users, user_ids, cascade_delete_users, cache_split, cache_misses, cache_growth, cache_hits, cache_keys, cache_stats, chunk_distinct, embed_new_texts,
        page_route, page_word_counts, vision_requests, page_assembly, document_texts, image_files, incremental_ingest, chunk_table,
    )
}
SQL = {
    "list_documents": f"WITH {LINES_SQL}, g AS (SELECT user_id, source, file_type AS t, count(*) AS chunk_count, max(file_mtime) AS last_modified FROM chunks GROUP BY ALL) SELECT user_id, source, coalesce(t, 'unknown') AS file_type, chunk_count, last_modified FROM g",
    "index_stats": f"WITH {LINES_SQL} SELECT user_id, sum(n)::BIGINT AS chunk_count, sum(f)::BIGINT AS file_count FROM (SELECT user_id, file_type, count(*) AS n, count(DISTINCT source) AS f FROM chunks GROUP BY ALL) GROUP BY user_id",
    "stored_types": f"WITH {LINES_SQL}, g AS (SELECT user_id, file_type AS t, count(*) AS n_chunks, count(DISTINCT source) AS n_files FROM chunks GROUP BY ALL) SELECT user_id, coalesce(t, 'unknown') AS file_type, n_chunks, n_files FROM g",
    "indexed_files": f"WITH {LINES_SQL} SELECT user_id, source, count(*) AS chunk_count FROM chunks GROUP BY ALL",
    "corpus_totals": f"WITH {LINES_SQL} SELECT user_id, count(DISTINCT source) AS n_files, count(*) AS n_chunks FROM chunks GROUP BY ALL",
    "file_type_counts": f"WITH {LINES_SQL} SELECT user_id, CASE WHEN e = '' THEN 'unknown' ELSE e END AS file_type, count(*) AS n_files FROM (SELECT DISTINCT user_id, source, regexp_extract(source, '[^./](\\.[^./]*)$', 1) AS e FROM chunks) GROUP BY ALL",
    "existing_files": f"WITH {STORED_SQL} SELECT user_id, source, stored AS content_hash FROM old",
    "change_detection": f"WITH {STORED_SQL} SELECT * FROM status",
    "files_to_process": f"WITH {STORED_SQL} SELECT * FROM status WHERE status IN ('new', 'modified')",
    "change_summary": f"""WITH {STORED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY source) AS k FROM status)
SELECT user_id, status, count(*) AS n_files, coalesce(string_agg(source, '|' ORDER BY source) FILTER (k <= 5 AND status <> 'unchanged'), '') AS sample FROM p GROUP BY user_id, status""",
    "replace_modified": f"""WITH {STORED_SQL}, fresh AS (SELECT user_id, source, f.content_hash, text FROM files f JOIN status USING (user_id, source) WHERE status = 'modified')
SELECT s.user_id, s.source, chunk_index::INT AS chunk_index, s.content_hash, md5(chunk) AS chunk_md5 FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.user_id = s.user_id AND f.source = s.source AND f.content_hash <> s.content_hash)
UNION ALL SELECT user_id, source, 0, content_hash, md5(text) FROM fresh""",
    "delete_sources": f"WITH {STORED_SQL} SELECT user_id, source, count(*) AS n FROM stored JOIN status USING (user_id, source) WHERE status <> 'deleted' GROUP BY ALL",
    "deletion_report": f"WITH {STORED_SQL} SELECT f.user_id, f.source, count(s.doc_id) AS n_deleted FROM files f LEFT JOIN stored s USING (user_id, source) WHERE f.doc_id % 3 = 0 GROUP BY ALL",
    "append_run": f"WITH {STORED_SQL}, every AS (SELECT user_id, source, content_hash, chunk_index FROM stored UNION ALL SELECT user_id, source, content_hash, chunk_index FROM chunks WHERE doc_id % 11 <> 0)\n"
    "SELECT user_id, source, count(*) AS n, count(DISTINCT content_hash) AS n_hashes, max(chunk_index)::BIGINT AS last_index FROM every GROUP BY ALL",
    "failed_sources": f"""WITH {LINES_SQL} SELECT user_id, source, CASE WHEN bool_or(length(chunk) > 2000) THEN 0 ELSE count(*) END AS n,
       CASE WHEN bool_or(length(chunk) > 2000) THEN 'ValueError: line too long' END AS error FROM chunks GROUP BY user_id, source""",
    "upsert_users": """WITH k AS (SELECT max(c_custkey) AS top FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey % 2 <> 0 AS fresh, count(*) AS n_users, count(*) AS n_ids, min('key-' || c_custkey) AS first_key, CASE WHEN c_custkey % 2 <> 0 THEN any_value(top) + count(*) ELSE max(c_custkey) END AS last_id
FROM customer, k GROUP BY c_custkey % 2""",
    "user_ids": "SELECT 'key-' || c_custkey AS api_key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END::BIGINT AS id FROM customer",
    "cascade_delete_users": f"WITH {LINES_SQL} SELECT user_id, count(*) AS n FROM chunks WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id",
    "cache_split": f"WITH {LINES_SQL}, known AS (SELECT DISTINCT chunk FROM chunks WHERE doc_id % 2 = 0) SELECT doc_id, count(k.chunk) AS n_hits, count(*) - count(k.chunk) AS n_misses FROM chunks c LEFT JOIN known k USING (chunk) GROUP BY doc_id",
    "cache_misses": f"WITH {LINES_SQL} SELECT DISTINCT sha256(chunk) AS digest, length(chunk)::INT AS n_chars FROM chunks WHERE chunk NOT IN (SELECT chunk FROM chunks WHERE doc_id % 2 = 0)",
    "cache_growth": f"WITH {LINES_SQL} SELECT sha256(chunk) AS digest, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'known' ELSE 'made' END AS value FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY chunk",
    "cache_hits": f"WITH {LINES_SQL}, known AS (SELECT DISTINCT chunk AS k FROM chunks WHERE doc_id % 2 = 0) SELECT count(*) AS n_rows, count(k) AS n_hits, count(DISTINCT CASE WHEN k IS NULL THEN chunk END) AS n_missing_keys FROM chunks LEFT JOIN known ON chunk = k",
    "chunk_distinct": f"{LOOSE_SQL} SELECT doc_id, count(*) AS n_chunks, max(length(chunk))::INT AS longest FROM chunk GROUP BY doc_id",
    "chunk_table": f"WITH RECURSIVE {FILES_SQL}, {CHUNKED_SQL} SELECT user_id, source, file_type, chunk_index, chunk FROM made JOIN files USING (doc_id)",
    "embed_new_texts": f"WITH {LINES_SQL} SELECT doc_id, chunk_index::INT AS chunk_index, 12 AS dim, ({LETTERS_SQL.format('chunk')})::BIGINT AS weight, NULL::VARCHAR AS error FROM chunks",
    "incremental_ingest": f"""WITH RECURSIVE {STORED_SQL}, {CHUNKED_SQL},
done AS (SELECT s.user_id, s.source, s.content_hash, count(*) AS n_chunks, 0 AS n_vectors, 0 AS weight FROM stored s JOIN status t USING (user_id, source) WHERE t.status = 'unchanged' GROUP BY ALL
         UNION ALL SELECT user_id, source, f.content_hash, count(*), count(*), sum({LETTERS_SQL.format('chunk')})::BIGINT FROM made JOIN files f USING (doc_id) JOIN status t USING (user_id, source) WHERE t.status IN ('new', 'modified') GROUP BY ALL)
SELECT * FROM done""",
    "cache_keys": "SELECT doc_id, 'embedding:' || left(sha256(text), 16) AS embedding_key, 'chunks:' || left(sha256(sha256(text) || '|500|100|no_ocr'), 16) AS chunk_key, 'chunks:' || left(sha256(sha256(text) || '|500|100|ocr|auto|50'), 16) AS ocr_key FROM documents",
    "cache_stats": f"WITH {FILES_SQL} SELECT 'chunks' AS kind, count(*) AS n_entries, sum(strlen(text))::BIGINT AS n_bytes FROM files UNION ALL SELECT 'ocr', count(*), sum(strlen(text))::BIGINT FROM files WHERE file_type = '.pdf'",
    "page_route": f"WITH {PAGES_SQL} SELECT path, page_num, strategy FROM routed",
    "page_word_counts": "WITH w AS (SELECT 'pdf' || (doc_id // 5) AS path, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) SELECT path, count(*) AS n_pages, sum(n)::BIGINT AS n_words, min(n)::INT AS fewest, max(n)::INT AS most FROM w GROUP BY path",
    "vision_requests": f"WITH {PAGES_SQL} SELECT sha256(sha256(content) || '|' || prompt) AS digest, count(*) AS n_uses, prompt, content FROM said WHERE said IS NULL GROUP BY prompt, content",
    "page_assembly": f"""WITH {PAGES_SQL}, m AS (SELECT path, page_num, string_agg(chr(10) || chr(10) || '[image: ' || said || ']', '' ORDER BY img_idx) AS marks, any_value(said) AS one FROM said GROUP BY ALL)
SELECT path, page_num, md5(CASE WHEN strategy = 'strict' THEN coalesce(one, '') ELSE text || coalesce(marks, '') END) AS text_md5 FROM routed LEFT JOIN m USING (path, page_num)""",
    "document_texts": f"""WITH {PAGES_SQL}, t AS (SELECT path, page_num, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS text FROM page)
SELECT path, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS recognised_md5, md5(coalesce(string_agg(text, ' ' ORDER BY page_num) FILTER (text <> ''), '')) AS plain_md5, md5(string_agg(text, ' ' ORDER BY page_num)) AS every_md5 FROM t GROUP BY path""",
    "image_files": f"""WITH {PAGES_SQL}, f AS (SELECT path || '/' || page_num || '.png' AS path, 'scan ' || (doc_id % 97) AS content FROM page)
SELECT path, CASE WHEN length(content) % 3 <> 0 THEN 'text of ' || content ELSE '[Unable to process image: ' || path || ']' END AS text FROM f""",
}
