"""Whole jobs: incremental ingest, a directory brought into the chunk table, contexts for a table of questions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.chunking import MAX_LEN, OVERLAP, chunk_documents
from docloom.functions.text import extension
from docloom.operators import context, embedding, incremental, rerank, retrieval
from docloom.operators.cache import write_back
from docloom.plans import recognition
from docloom.schemas import REPLIES
from docloom.sources import chunk_table
from docloom.sources import files as file_tables
from docloom.sources.bytes_to_text import read_files
from docloom.sources.scratch import discard, materialise, new_path, settings

FILE = ["user_id", "source"]


def chunk_files(files: DataFrame, max_len: int = MAX_LEN, overlap: int = OVERLAP) -> DataFrame:
    """(user_id, source, file_type, content_hash, file_mtime, chunk_index, chunk) of files with text.

    PDF text goes through the bounded chunker, everything else through the loose one.
    """
    keys = ["user_id", "source", "file_type", "content_hash", "file_mtime"]
    return chunk_documents(files, keys, "text", F.coalesce(F.col("file_type") == ".pdf", F.lit(False)), max_len, overlap)


@dataclass
class Ingested:
    """What an incremental run gives: the new chunk table, the grown cache, statuses, failures."""

    chunks: DataFrame
    cache: DataFrame
    classified: DataFrame
    failed: DataFrame
    requests: DataFrame | None = None
    #: Tables that ``chunks`` and ``cache`` are made of.
    written: tuple[DataFrame, ...] = ()


def ingest(files: DataFrame, chunks: DataFrame, known: DataFrame, model: embedding.Model, scope: str | None = None) -> Ingested:
    """Bring ``chunks`` up to date with ``files`` (user_id, source, file_type, content_hash, file_mtime, text).

    Only hashes are compared; only new and modified files are chunked, only unknown chunk texts embedded. A
    file with a failed chunk keeps its old rows; files that are gone lose theirs. ``scope`` limits what counts
    as gone to a path prefix.
    """
    current = files.select(*FILE, "content_hash", F.col("file_mtime").alias("mtime"))
    classified = materialise(incremental.classify(current, incremental.existing_files(chunks, scope)), "classified")
    changed = files.join(incremental.to_process(classified).select(*FILE), FILE, "left_semi")
    return apply_changes(classified, changed.withColumn("error", F.lit(None).cast("string")), chunks, known, model)


def apply_changes(classified: DataFrame, changed: DataFrame, chunks: DataFrame, known: DataFrame, model: embedding.Model, written: tuple[DataFrame, ...] = ()) -> Ingested:
    """Put the ``changed`` files (as in ``ingest``, with ``error`` where there is no text) into ``chunks``.

    What was chunked and what the model gave is written once, and everything is derived from that: a model that fails
    now and then never gives one answer to the new rows and another one to the list of failures. ``written`` are scratch tables
    that ``changed`` is read from: they are deleted when it is chunked.
    """
    unread = materialise(changed.where("error IS NOT NULL").select(*FILE, "error"), "unread")
    made = materialise(chunk_files(changed.where("error IS NULL")), "chunks")
    discard(*written)
    embedded, new = embedding.embed_new(made, known, model, "chunk")
    rows = materialise(embedded, "embedded-chunks")
    discard(made)
    # The few failures are written first, so that no job deals the rows out to compare them.
    failed = materialise(incremental.complete_sources(rows)[1].unionByName(unread), "failed")
    fresh = incremental.chunk_rows(rows)
    modified = classified.where(F.col("status") == incremental.MODIFIED).select(*FILE, "content_hash")
    kept = incremental.delete_sources(chunks, incremental.to_delete(classified))
    return Ingested(incremental.replace_modified(kept, fresh, failed, modified), write_back(known, new), classified, failed, written=(rows, new))


def index_directory(
    spark: SparkSession, directory: str, table: str, cache: str, model: embedding.Model, user_id: int, extensions: list[str] | None = None, recognised: DataFrame | None = None, said: DataFrame | None = None
) -> Ingested:
    """Bring one user's part of the chunk table at ``table`` up to date with the files under ``directory``.

    The listing keeps names and hashes only; texts are read of what is new or modified. Vectors go to the cache
    table at ``cache``, shared by all users, which only grows. Files that cannot be read, pictures and PDF files
    without recognised text are in ``failed`` and keep their old rows. Files of other ``extensions`` than those asked for, and of
    other folders, stay as they are. A repeated run changes nothing.

    With ``said`` (digest, text), what a model said about pictures, office files are stored with the texts of the pictures inside them
    and fail while one is missing; ``requests`` (digest, prompt, content) then has each missing picture once, however many files hold it.
    """
    found = file_tables.scan_directory(spark, directory, extensions)
    with settings(spark, spark__sql__files__openCostInBytes=file_tables.OPEN_COST):
        listed = materialise(found.select(F.lit(user_id).alias("user_id"), F.col("path").alias("source"), "content_hash", "mtime"), "listing")
    chunks = chunk_table.stored_chunks(spark, table, user_id)
    stored = incremental.existing_files(chunks, re.sub("^file:/+", "/", directory).rstrip("/") + "/")
    if extensions is not None:
        stored = stored.where(extension("source").isin([e.lower() for e in extensions]))
    classified = materialise(incremental.classify(listed, stored), "classified")
    work = incremental.to_process(classified).select(F.col("source").alias("path"))
    with settings(spark, spark__sql__files__openCostInBytes=file_tables.OPEN_COST):
        todo = materialise(found.join(work, "path", "left_semi"), "changed-files")
    changed, requests = changed_texts(todo, user_id, recognised, said)
    known = embedding.stored_vectors(spark, cache)
    done = apply_changes(classified, changed, chunks, known, model, (changed,))
    done.cache.join(known.select("digest"), "digest", "left_anti").write.mode("append").parquet(cache)
    made, new = done.written
    discard(new)
    if classified.where(F.col("status") != incremental.UNCHANGED).isEmpty():
        discard(made)
    else:
        chunk_table.write_snapshot(done.chunks, table, new_path(spark, "snapshot"), user_id, chunks.select("user_id").unionByName(made.select("user_id")), (made,))
    return Ingested(chunk_table.stored_chunks(spark, table, user_id), embedding.stored_vectors(spark, cache), classified, done.failed, requests)


def changed_texts(todo: DataFrame, user_id: int, recognised: DataFrame | None, said: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The texts of changed files as ``apply_changes`` takes them, written once, and the pictures to ask about (none without ``said``). The bytes are read once, then ``todo`` is deleted."""
    spark, user = todo.sparkSession, F.lit(user_id).cast("int").alias("user_id")
    none = F.lit(None).cast("string")
    named = todo.select(user, F.col("path").alias("source"), "path", F.col("ext").alias("file_type"), "content_hash", F.col("mtime").alias("file_mtime"), "ext", "content", none.alias("error"))
    read = materialise(read_files(named).drop("ext"), "read-files")
    discard(todo)
    answers = spark.createDataFrame([], REPLIES) if said is None else said.select("digest", none.alias("path"), "text")
    if recognised is not None:
        answers = answers.unionByName(recognised.select(none.alias("digest"), "path", "text"))
    settled = materialise(recognition.settle(recognition.needs_of(read, said is not None), answers), "changed-texts")
    requests = None if said is None else materialise(recognition.picture_requests(read, answers), "picture-requests")
    discard(read)
    changed = settled.drop("needs", "path")
    changed.scratch_path = settled.scratch_path
    return changed, requests


def answer_questions(chunks: DataFrame, questions: DataFrame, model: embedding.Model, **options) -> dict[str, DataFrame]:
    """The stages of ``question_contexts`` for questions (query_id, user_id, question) that have no vectors yet, and ``failed`` (query_id, error)."""
    asked = embedding.embed_questions(questions, model)
    found = question_contexts(chunks, asked.where("error IS NULL").drop("error"), **options)
    return found | {"failed": asked.where("error IS NOT NULL").select("query_id", "error")}


def question_contexts(chunks: DataFrame, queries: DataFrame, replies: DataFrame | None = None, on_reject: str = "fallback", radius: int = retrieval.RADIUS, skip_self: bool = False) -> dict[str, DataFrame]:
    """The stages of answering ``queries`` from ``chunks``: candidates, kept, reranked, expanded, context, prompts, funnel.

    The candidates are written once, so that the stages do not search the chunks again.
    """
    found = materialise(retrieval.top_k(chunks, queries, skip_self), "candidates")
    kept = retrieval.cut_off(found)
    texts = chunks.select("user_id", "source", "chunk_index", "chunk_id", "chunk", "header")
    with_text = kept.join(texts.select("chunk_id", "chunk", "header"), "chunk_id")
    empty = queries.select("query_id", F.lit(None).cast("string").alias("response"))
    reranked = rerank.apply_rerank(with_text, empty if replies is None else replies, on_reject=on_reject, use=replies is not None)
    expanded = retrieval.expand_context(reranked, chunks, radius, most_hits=queries.count() * rerank.TOP_K)
    contexts = context.context_text(expanded)
    prompts = context.prompts(queries, contexts, retrieval.low_confidence(queries, kept))
    corpus = retrieval.corpus_size(chunks, queries)
    funnel = context.funnel(queries, candidates=found, kept=kept, reranked=reranked, expanded=expanded).join(corpus, "query_id")
    return {"candidates": found, "kept": kept, "requests": rerank.rerank_requests(with_text, queries), "reranked": reranked, "expanded": expanded, "context": contexts, "prompts": prompts, "funnel": funnel}
