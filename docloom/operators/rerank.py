"""Rerank requests, and replies applied with repair and fallback; the model itself is a table of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import preview
from docloom.schemas import RERANK_REPLY

TOP_K, SNIPPET = 5, 500


def reply_body(reply):
    """The text between code fences, without a leading ``json``; the reply itself where there are none."""
    fenced = F.get(F.split(reply, "```"), F.lit(1))
    return F.trim(F.when(reply.contains("```"), F.regexp_replace(fenced, r"^\s*json", "")).otherwise(reply))


def rerank_requests(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, question, numbered, n): the candidates of each question as numbered text, counted from 0."""
    head = F.when(F.coalesce("header", F.lit("")) != "", F.concat("header", F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] "), head, preview("chunk", SNIPPET), F.lit("\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "")
    numbered = candidates.groupBy("query_id").agg(text.alias("numbered"), F.count(F.lit(1)).alias("n"))
    return queries.select("query_id", "question").join(numbered, "query_id").select("query_id", "question", "numbered", "n")


def parse_replies(replies: DataFrame) -> DataFrame:
    """(query_id, indices, rejected, failed) of (query_id, response): ``failed`` where no index list can be read."""
    parsed = replies.withColumn("r", F.from_json(reply_body(F.col("response")), RERANK_REPLY))
    indices = F.transform("r.indices", lambda x: x.try_cast("int"))
    rejected = F.coalesce("r.rejected", F.lit(False)) | (F.size("r.indices") == 0)
    return parsed.select("query_id", indices.alias("indices"), F.coalesce(rejected, F.lit(False)).alias("rejected"), F.col("r.indices").isNull().alias("failed"))


def repair_indices(indices, n):
    """Indices in range, the first of equal ones, in their order."""
    return F.array_distinct(F.filter(indices, lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def apply_rerank(candidates: DataFrame, replies: DataFrame, top_k: int = TOP_K, on_reject: str = "fallback", use: bool = True) -> DataFrame:
    """``candidates`` cut and reordered by the replies, with ``place`` from 1 and ``rejected``.

    A failed or missing reply keeps the order. A rejected one keeps it too (``fallback``) or leaves nothing
    (``empty``); without ``use`` the first ``top_k`` stay.
    """
    first = candidates.where(F.col("rank") <= top_k).withColumn("place", F.col("rank"))
    if not use:
        return first.withColumn("rejected", F.lit(False))
    sizes = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    state = sizes.join(parse_replies(replies), "query_id", "left").withColumn("failed", F.coalesce("failed", F.lit(True)))
    state = state.withColumn("order", F.when(~F.col("failed") & ~F.col("rejected"), repair_indices(F.col("indices"), F.col("n"))))
    state = state.withColumn("rejected", ~F.col("failed") & (F.col("rejected") | (F.size("order") == 0)))
    chosen = state.where("NOT failed AND NOT rejected").select("query_id", F.posexplode(F.slice("order", 1, top_k)).alias("pos", "idx"))
    moved = candidates.join(chosen, (candidates["query_id"] == chosen["query_id"]) & (candidates["rank"] == chosen["idx"] + 1)).select(candidates["*"], (F.col("pos") + 1).alias("place"), F.lit(False).alias("rejected"))
    kept = state.where("failed" if on_reject == "empty" else "failed OR rejected").select("query_id", "rejected")
    return moved.unionByName(first.join(kept, "query_id"))


def rejected_queries(queries: DataFrame, candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, rejected) of every question; one without candidates is rejected."""
    sizes = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    state = queries.select("query_id").join(sizes, "query_id", "left").join(parse_replies(replies), "query_id", "left")
    nothing = F.size(repair_indices(F.col("indices"), F.col("n"))) == 0
    return state.select("query_id", (F.col("n").isNull() | (~F.coalesce("failed", F.lit(True)) & (F.col("rejected") | nothing))).alias("rejected"))
