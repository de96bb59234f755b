"""How the given tables stand in for files, chunks, questions and replies; each frame has a twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".pdf", ".txt", ".md", ".docx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(start: str, minutes):
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four users; every fifth has no extension and no type."""
    kind = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumn("file_type", kind)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.coalesce("file_type", F.lit("")))
    return docs.select(
        "doc_id", (F.col("doc_id") % 4).cast("int").alias("user_id"), path.alias("source"), "file_type",
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("content_hash"), minutes_after("2024-01-01", F.col("doc_id")).alias("file_mtime"), "text",
    )


FILES_SQL = """files AS (
  SELECT doc_id, (doc_id % 4)::INT AS user_id, t.source || '/' || doc_id || coalesce(file_type, '') AS source, file_type,
         substr(sha256(text), 1, 16) AS content_hash, TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS file_mtime, text
  FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' WHEN 3 THEN '.docx' END AS file_type FROM documents) t)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every line of every file."""
    rows = files(spark, sf_dir).select("doc_id", "user_id", "source", "file_type", "content_hash", "file_mtime", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk"))
    return rows.withColumns({"header": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})


LINES_SQL = (
    FILES_SQL
    + """,
chunks AS (SELECT doc_id, user_id, source, file_type, content_hash, file_mtime, unnest(a) AS chunk, generate_subscripts(a, 1) - 1 AS chunk_index
           FROM (SELECT *, string_split(text, chr(10)) AS a FROM files))"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks of eight users, ten to a file; the text is the document of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")
    tens = F.floor(F.col("vec_id") / 10)
    return rows.select(
        F.col("vec_id").alias("chunk_id"), (tens % 8).cast("int").alias("user_id"), F.concat(F.lit("file"), tens.cast("string")).alias("source"), (F.col("vec_id") % 10).cast("int").alias("chunk_index"),
        F.coalesce("text", F.lit("")).alias("chunk"), F.when(F.col("vec_id") % 2 == 1, F.concat(F.lit("Part "), F.col("vec_id").cast("string"))).alias("header"), "embedding",
        minutes_after("2024-01-01", F.col("vec_id")).alias("file_mtime"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twenty-fifth vector is a question of its user."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 25 = 0")
    tens = F.floor(F.col("vec_id") / 10)
    return rows.select(F.col("vec_id").alias("query_id"), (tens % 8).cast("int").alias("user_id"), F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("question"), "embedding")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerank reply for every question but each seventh: lists with faults, rejections, text that is no JSON."""
    q = F.col("query_id") / 25
    pick = (q % 6).cast("int")
    text = (
        F.when(pick == 0, '```json\n{"indices": [3, 0, 3, 99, -1, 1]}\n```')
        .when(pick == 1, '{"indices": ["2", 1, "x"]}')
        .when(pick == 2, '{"indices": [], "rejected": true}')
        .when(pick == 3, "no list here")
        .when(pick == 4, '{"indices": [77, 88]}')
        .otherwise('{"indices": [1, 0, 2, 3, 4, 5, 6]}')
    )
    return questions(spark, sf_dir).where((F.col("query_id") / 25) % 7 != 6).select("query_id", text.alias("response"))


VECTORS_SQL = """vec AS (
  SELECT vec_id AS chunk_id, ((vec_id // 10) % 8)::INT AS user_id, 'file' || (vec_id // 10) AS source, (vec_id % 10)::INT AS chunk_index,
         coalesce(text, '') AS chunk, CASE WHEN vec_id % 2 = 1 THEN 'Part ' || vec_id END AS header, embedding, TIMESTAMP '2024-01-01' + to_minutes(vec_id::INT) AS file_mtime
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
queries AS (SELECT vec_id AS query_id, ((vec_id // 10) % 8)::INT AS user_id, 'question ' || vec_id AS question, embedding FROM embeddings WHERE vec_id % 25 = 0),
corpus AS (SELECT query_id, count(chunk_id) AS corpus FROM queries q LEFT JOIN vec c ON q.user_id = c.user_id GROUP BY query_id),
scored AS (SELECT query_id, c.user_id, source, chunk_index, chunk_id, (1 + list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2 AS similarity
           FROM queries q JOIN vec c ON q.user_id = c.user_id AND query_id <> chunk_id),
cand AS (SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source, chunk_index) AS rank FROM scored) r
         JOIN corpus USING (query_id) WHERE rank <= greatest(least(20, floor(corpus * 0.5)), 1)),
kept AS (SELECT * EXCLUDE (stop, stops) FROM (
           SELECT *, sum(stop) OVER (PARTITION BY query_id ORDER BY rank) AS stops FROM (
             SELECT *, first_value(similarity) OVER w < 0.65 AS low_confidence,
                    CASE WHEN rank > 1 AND (similarity < 0.65 OR lag(similarity) OVER w - similarity > 0.10 OR first_value(similarity) OVER w < 0.65) THEN 1 ELSE 0 END AS stop
             FROM cand WINDOW w AS (PARTITION BY query_id ORDER BY rank)))
         WHERE stops = 0)"""


def replies_sql(rows: str = "cand") -> str:
    """Replies of ``replies`` to the candidates in ``rows`` as lists: what repair leaves, whether they fail, whether they are rejected."""
    return VECTORS_SQL + _REPLIES.replace("cand", rows)


_REPLIES = """,
size AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id),
reply AS (SELECT query_id, n, CASE WHEN (query_id // 25) % 7 = 6 THEN 3 ELSE (query_id // 25) % 6 END AS pick FROM size),
state AS (SELECT query_id, n, pick = 3 AS failed,
                 list_filter(CASE pick WHEN 0 THEN [3, 0, 1] WHEN 1 THEN [2, 1] WHEN 4 THEN [77, 88] WHEN 5 THEN [1, 0, 2, 3, 4, 5, 6] ELSE [] END, lambda x: x < n) AS idx FROM reply),
chosen AS (SELECT query_id, unnest(idx) AS i, generate_subscripts(idx, 1) AS place FROM state WHERE NOT failed AND len(idx) > 0),
reranked AS (SELECT c.*, place, FALSE AS rejected FROM cand c JOIN chosen s ON c.query_id = s.query_id AND c.rank = s.i + 1 WHERE place <= 5
             UNION ALL SELECT c.*, rank AS place, NOT failed AS rejected FROM cand c JOIN state s USING (query_id) WHERE (failed OR len(idx) = 0) AND rank <= 5)"""

#: Letters that the stand-in model of the queries counts; its vectors have a twin in SQL.
LETTERS = "etaoinshrdlu"


def letter_model(texts: list[str]) -> list[list[float]]:
    return [[float(text.count(c)) for c in LETTERS] for text in texts]


def letter_weight(vector: str):
    """The numbers of a vector in one: each times its place."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)


#: ``letter_weight`` of the vector of a text.
LETTERS_SQL = "(" + " + ".join(f"{k} * (length({{0}}) - length(replace({{0}}, '{c}', '')))" for k, c in enumerate(LETTERS, 1)) + ")"
