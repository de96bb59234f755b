"""Queries over embedded chunks and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import context, embedding, rerank, retrieval
from docloom.plans.corpora import VECTORS_SQL, questions, replies, replies_sql, vectors
from docloom.plans.corpora import LETTERS_SQL, letter_model, letter_weight
from docloom.plans.jobs import answer_questions, question_contexts
from docloom.schemas import VECTORS
from docloom.sources.scratch import materialise


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, queries = vectors(spark, sf_dir), questions(spark, sf_dir)
    return chunks, queries, retrieval.top_k(chunks, queries, skip_self=True)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[2].select("query_id", "rank", "chunk_id", "source", "chunk_index", F.round("similarity", 4).alias("similarity"))


def corpus_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_size(vectors(spark, sf_dir), questions(spark, sf_dir)).withColumn("k", retrieval.candidate_limit(F.col("corpus")))


def similarity_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cut_off(_found(spark, sf_dir)[2]).select("query_id", "rank", "chunk_id", F.round("similarity", 4).alias("similarity"), "low_confidence")


def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, found = _found(spark, sf_dir)
    out = retrieval.expand_context(found.where("rank <= 5"), chunks)
    return out.select("query_id", "source", "chunk_index", F.round("similarity", 4).alias("similarity"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), "header")


def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.file_search(_found(spark, sf_dir)[2])


def file_search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.file_search(_found(spark, sf_dir)[2], limit=5, digits=3, pool=10)


def apply_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rerank.apply_rerank(_found(spark, sf_dir)[2], replies(spark, sf_dir))
    return out.select("query_id", "place", "chunk_id", "rejected")


def rerank_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rerank.apply_rerank(_found(spark, sf_dir)[2], replies(spark, sf_dir), on_reject="empty")
    return out.select("query_id", "place", "chunk_id")


def rerank_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queries, found = _found(spark, sf_dir)
    return rerank.rejected_queries(queries, found, replies(spark, sf_dir))


def rerank_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries, found = _found(spark, sf_dir)
    out = rerank.rerank_requests(found.join(chunks.select("chunk_id", "chunk", "header"), "chunk_id"), queries)
    return out.select("query_id", "question", "n", F.md5(F.col("numbered").cast("binary")).alias("numbered_md5"))


def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, found = _found(spark, sf_dir)
    return context.context_text(retrieval.expand_context(found.where("rank <= 5"), chunks))


def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, found = _found(spark, sf_dir)
    return context.chunk_labels(retrieval.expand_context(found.where("rank <= 5"), chunks))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, found = _found(spark, sf_dir)
    return context.source_list(found.withColumn("place", F.col("rank")).join(chunks.select("chunk_id", "chunk", "header"), "chunk_id"))


def retrieval_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each stage of the whole way leaves of each question."""
    queries = questions(spark, sf_dir)
    stages = question_contexts(vectors(spark, sf_dir), queries, replies(spark, sf_dir), skip_self=True)
    return stages["funnel"].join(retrieval.low_confidence(queries, stages["kept"]), "query_id")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in conversations as questions, embedded with letter counts."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    asked = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 8).cast("int").alias("user_id"), F.col("text").alias("question"))
    return embedding.embed_questions(asked, letter_model).select("query_id", "user_id", letter_weight("embedding").alias("weight"), "error")


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From questions without vectors to the funnel: chunks and questions are embedded with letter counts."""
    # Written once, as are the embedded ones below: each of the many readers would join all texts again.
    chunks = materialise(vectors(spark, sf_dir).drop("embedding"), "chunks-to-embed")
    none = spark.createDataFrame([], VECTORS)
    embedded = materialise(embedding.embed_rows(chunks, none, letter_model, "chunk")[0].drop("error"), "embedded-chunks")
    asked = questions(spark, sf_dir).join(chunks.select(F.col("chunk_id").alias("query_id"), F.substring("chunk", 1, 200).alias("start")), "query_id")
    return answer_questions(embedded, asked.select("query_id", "user_id", F.col("start").alias("question")), letter_model)["funnel"].select("query_id", "n_candidates", "corpus")


def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from questions to prompts, with replies of a model."""
    return question_contexts(vectors(spark, sf_dir), questions(spark, sf_dir), replies(spark, sf_dir), skip_self=True)["prompts"]


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries, found = _found(spark, sf_dir)
    contexts = context.context_text(retrieval.expand_context(found.where("rank <= 5"), chunks))
    return context.prompts(queries, contexts, retrieval.low_confidence(queries, retrieval.cut_off(found)))


def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.approximate_top_k(vectors(spark, sf_dir), questions(spark, sf_dir), skip_self=True).select("query_id", "rank", "chunk_id", F.round("similarity", 4).alias("similarity"))


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.text import vector_from_text, vector_text

    """Vectors to text and back: dimension and parts of what was read again."""
    rows = vectors(spark, sf_dir).select("chunk_id", vector_text("embedding").alias("text"))
    back = vector_from_text("text", 64)
    return rows.select("chunk_id", F.size(back).alias("dim"), F.substring("text", 1, 1).alias("first"), *[F.get(back, F.lit(k)).cast("double").alias(f"x{k}") for k in (0, 31, 63)])


def _expanded(rows: str = "cand", condition: str = "rank <= 5") -> str:
    """Hits with their neighbours and the context text made of them."""
    return f""",
around AS (SELECT query_id, user_id, source, chunk_index + d AS chunk_index, CASE WHEN d = 0 THEN similarity ELSE 0.0 END AS similarity FROM {rows}, (SELECT unnest([-1, 0, 1]) AS d) WHERE {condition}),
place AS (SELECT query_id, user_id, source, chunk_index, max(similarity) AS similarity FROM around GROUP BY ALL),
expanded AS (SELECT p.*, chunk, header FROM place p JOIN vec v USING (user_id, source, chunk_index)),
ctx AS (SELECT query_id, string_agg('[Chunk ' || (chunk_index + 1) || '] ' || CASE WHEN coalesce(header, '') <> '' THEN header || ' ' ELSE '' END || '(source: ' || source || ')' || chr(10) || chunk || chr(10) || chr(10), '' ORDER BY source, chunk_index) AS context, count(*) AS n_chunks
        FROM expanded GROUP BY query_id)
"""


EXPANDED, ANSWERED = _expanded(), _expanded("reranked", "TRUE")
LOW = ", low AS (SELECT query_id, coalesce(bool_or(low_confidence), TRUE) AS low_confidence FROM queries LEFT JOIN kept USING (query_id) GROUP BY query_id)"


PROMPTS = f"""SELECT query_id, CASE WHEN low_confidence THEN '{context.NOTICE.strip()}' || chr(10) ELSE '' END
       || 'Answer from the passages below and cite them by their [Chunk n] marks; say when they do not hold the answer.' || chr(10) || chr(10) || coalesce(context, '') || 'Question: ' || question || chr(10) AS prompt
FROM queries LEFT JOIN ctx USING (query_id) LEFT JOIN low USING (query_id)"""


def _file_search_sql(pool: int, limit: int, digits: int) -> str:
    return f"""WITH {VECTORS_SQL},
f AS (SELECT query_id, source, max(similarity) AS best, arg_min(chunk_id, rank) AS best_chunk, count(*) AS chunk_count FROM cand WHERE rank <= {pool} GROUP BY query_id, source),
p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_files, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, source) AS place FROM f)
SELECT query_id, place, source, round(best, {digits}) AS similarity, best_chunk, chunk_count, total_files FROM p WHERE place <= {limit}"""


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, corpus_limits, similarity_cutoff, expand_context, file_search, file_search_dedup, apply_rerank, rerank_strict, rerank_state, rerank_requests,
        context_text, context_labels, source_list, retrieval_funnel, prompt_texts, retrieve_context, lsh_topk, vector_texts, question_vectors, answered_questions,
    )
}
SQL = {
    "vector_topk": f"WITH {VECTORS_SQL} SELECT query_id, rank, chunk_id, source, chunk_index, round(similarity, 4) AS similarity FROM cand",
    "corpus_limits": f"WITH {VECTORS_SQL} SELECT query_id, corpus, greatest(least(20, floor(corpus * 0.5)), 1)::INT AS k FROM corpus",
    "similarity_cutoff": f"WITH {VECTORS_SQL} SELECT query_id, rank, chunk_id, round(similarity, 4) AS similarity, low_confidence FROM kept",
    "expand_context": f"WITH {VECTORS_SQL}{EXPANDED} SELECT query_id, source, chunk_index, round(similarity, 4) AS similarity, md5(chunk) AS chunk_md5, header FROM expanded",
    "file_search": _file_search_sql(20, 10, 4),
    "file_search_dedup": _file_search_sql(10, 5, 3),
    "apply_rerank": f"WITH {replies_sql()} SELECT query_id, place, chunk_id, rejected FROM reranked",
    "rerank_strict": f"WITH {replies_sql()} SELECT query_id, place, chunk_id FROM reranked WHERE NOT rejected",
    "rerank_state": f"WITH {replies_sql()} SELECT query_id, coalesce(NOT failed AND len(idx) = 0, TRUE) AS rejected FROM queries LEFT JOIN state USING (query_id)",
    "rerank_requests": f"""WITH {VECTORS_SQL}
SELECT query_id, question, count(*) AS n,
       md5(string_agg('[' || (rank - 1) || '] ' || CASE WHEN coalesce(header, '') <> '' THEN header || chr(10) ELSE '' END || left(chunk, 500) || CASE WHEN length(chunk) > 500 THEN '...' ELSE '' END || chr(10) || chr(10), '' ORDER BY rank)) AS numbered_md5
FROM cand JOIN queries USING (query_id) JOIN vec USING (chunk_id) GROUP BY query_id, question""",
    "context_text": f"WITH {VECTORS_SQL}{EXPANDED} SELECT * FROM ctx",
    "context_labels": f"WITH {VECTORS_SQL}{EXPANDED} SELECT query_id, source, chunk_index, CASE WHEN similarity > 0 THEN printf('similarity: %.3f', similarity) ELSE 'context' END AS label FROM expanded",
    "source_list": f"""WITH {VECTORS_SQL} SELECT query_id, rank AS place, cand.source AS file, cand.chunk_index, round(similarity, 4) AS similarity, header,
       left(chunk, 200) || CASE WHEN length(chunk) > 200 THEN '...' ELSE '' END AS preview FROM cand JOIN vec USING (chunk_id) WHERE rank <= 10""",
    "retrieval_funnel": f"""WITH {replies_sql("kept")}{ANSWERED}{LOW}
SELECT query_id, (SELECT count(*) FROM cand c WHERE c.query_id = q.query_id) AS n_candidates, (SELECT count(*) FROM kept k WHERE k.query_id = q.query_id) AS n_kept,
       (SELECT count(*) FROM reranked r WHERE r.query_id = q.query_id) AS n_reranked, (SELECT count(*) FROM expanded e WHERE e.query_id = q.query_id) AS n_expanded, low_confidence, corpus
FROM queries q JOIN low USING (query_id) JOIN corpus USING (query_id)""",
    "retrieve_context": f"WITH {replies_sql('kept')}{ANSWERED}{LOW}\n{PROMPTS}",
    "question_vectors": f"SELECT conv_id * 1000 + turn AS query_id, (conv_id % 8)::INT AS user_id, {LETTERS_SQL.format('text')} AS weight, NULL::VARCHAR AS error FROM conversations WHERE role = 'user'",
    "answered_questions": f"WITH {VECTORS_SQL}, letters AS (SELECT * FROM vec WHERE {LETTERS_SQL.format('chunk')} > 0), n AS (SELECT query_id, count(v.chunk_id) AS usable FROM queries q LEFT JOIN letters v USING (user_id) GROUP BY query_id)\n"
    "SELECT query_id, CASE WHEN q.weight = 0 THEN 0 ELSE least(greatest(least(20, floor(corpus * 0.5)), 1), usable) END::BIGINT AS n_candidates, corpus FROM corpus JOIN n USING (query_id) JOIN "
    f"(SELECT chunk_id AS query_id, {LETTERS_SQL.format('left(chunk, 200)')} AS weight FROM vec) q USING (query_id)",
    "prompt_texts": f"WITH {VECTORS_SQL}{EXPANDED}{LOW}\n{PROMPTS}",
    "vector_texts": "SELECT vec_id AS chunk_id, len(embedding)::INT AS dim, '[' AS first, embedding[1]::DOUBLE AS x0, embedding[32]::DOUBLE AS x31, embedding[64]::DOUBLE AS x63 FROM embeddings",
}
