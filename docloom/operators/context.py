"""Context text, prompts, source lists and counters of a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import preview

NOTICE = "The passages found fit the question only loosely; say so first, then give what they hold.\n"
PROMPT = "{notice}Answer from the passages below and cite them by their [Chunk n] marks; say when they do not hold the answer.\n\n{context}Question: {question}\n"


def context_text(expanded: DataFrame) -> DataFrame:
    """(query_id, context, n_chunks): chunks in order of source and place, numbered from 1."""
    head = F.when(F.coalesce("header", F.lit("")) != "", F.concat("header", F.lit(" "))).otherwise("")
    block = F.concat(F.lit("[Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("] "), head, F.lit("(source: "), "source", F.lit(")\n"), "chunk", F.lit("\n\n"))
    blocks = F.array_sort(F.collect_list(F.struct("source", "chunk_index", block.alias("block"))))
    return expanded.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "").alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def chunk_labels(expanded: DataFrame) -> DataFrame:
    """(query_id, source, chunk_index, label): the similarity to three digits, or ``context`` for neighbours."""
    label = F.when(F.col("similarity") > 0, F.format_string("similarity: %.3f", "similarity")).otherwise("context")
    return expanded.select("query_id", "source", "chunk_index", label.alias("label"))


def prompts(queries: DataFrame, contexts: DataFrame, flags: DataFrame, template: str = PROMPT, notice: str = NOTICE) -> DataFrame:
    """(query_id, prompt) for a batch of model calls; the notice only where confidence is low."""
    rows = queries.select("query_id", "question").join(contexts, "query_id", "left").join(flags, "query_id", "left")
    values = {"notice": F.when(F.coalesce("low_confidence", F.lit(True)), F.lit(notice)).otherwise(""), "context": F.coalesce("context", F.lit("")), "question": F.col("question")}
    parts, rest = [], template
    while rest:
        name = min((k for k in values if f"{{{k}}}" in rest), key=lambda k: rest.index(f"{{{k}}}"), default=None)
        text, rest = rest.split(f"{{{name}}}", 1) if name else (rest, "")
        parts += [F.lit(text)] + ([values[name]] if name else [])
    return rows.select("query_id", F.concat(*parts).alias("prompt"))


def source_list(rows: DataFrame, limit: int = 10, digits: int = 4) -> DataFrame:
    """(query_id, place, file, chunk_index, similarity, header, preview): the first ``limit`` rows of each question by ``place``."""
    order = Window.partitionBy("query_id").orderBy("place")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return first.select("query_id", "place", F.col("source").alias("file"), "chunk_index", F.round("similarity", digits).alias("similarity"), "header", preview("chunk").alias("preview"))


def funnel(queries: DataFrame, **stages: DataFrame) -> DataFrame:
    """(query_id, n_<stage>...): rows of each question after each stage; all stages are counted in one pass."""
    tagged = None
    for name, rows in stages.items():
        part = rows.select("query_id", F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("query_id").agg(*[F.count_if(F.col("stage") == name).alias(f"n_{name}") for name in stages])
    return queries.select("query_id").join(counts, "query_id", "left").na.fill(0, [f"n_{name}" for name in stages])
