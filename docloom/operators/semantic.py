"""Chunks by sentence boundaries that a model proposes: requests out, replies in, with fallback and merging.

The sentences of a document stay in one row, where they are packed, numbered and joined by column functions.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import sentence_tokens, word_count
from docloom.operators.rerank import reply_body
from docloom.schemas import BOUNDARY_REPLY

TARGET_WORDS, MIN_WORDS, FALLBACK_HEADER = 2000, 200, "Content section"
BOUNDS = "array<struct<block:int,pos:int,start:int,end:int,header:string>>"


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, sentence, words): the sentences of each document from 0."""
    rows = docs.select(key, F.posexplode(sentence_tokens(text)).alias("i", "sentence"))
    return rows.withColumn("words", word_count("sentence"))


def sentence_lists(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sentences, words): all sentences of a document and their words in one row; documents without any are left out."""
    rows = docs.select(key, sentence_tokens(text).alias("sentences")).where(F.size("sentences") > 0)
    return rows.withColumn("words", F.transform("sentences", word_count))


def packed_ranges(words: list[int], target: int) -> list[tuple[int, int]]:
    """Inclusive ranges of places packed greedily; a new one starts when the target would be passed by a range that has words."""
    ranges: list[tuple[int, int]] = []
    start = total = 0
    for i, n in enumerate(words):
        if total > 0 and total + n > target:
            ranges.append((start, i - 1))
            start, total = i, 0
        total += n
    return [*ranges, (start, len(words) - 1)]


def merged_ranges(starts: list[int], ends: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Inclusive ranges of boundaries: from the left, one of too few words takes in the next; the last is never merged backwards."""
    before = [0, *accumulate(words)]
    ranges: list[tuple[int, int]] = []
    first = 0
    for k in range(1, len(starts)):
        start = min(max(starts[first], 0), len(words))
        stop = max(start, min(ends[k - 1] + 1, len(words)))
        if before[stop] - before[start] >= least:
            ranges.append((first, k - 1))
            first = k
    return [*ranges, (first, len(starts) - 1)] if starts else ranges


def _ranges(fold: Callable[..., list[tuple[int, int]]], **options: int):
    """``fold`` over lists of numbers of a row as a column function; time and memory grow with the lists."""

    def run(*columns: pa.Array) -> pa.Array:
        found = [None if None in row else [{"first": a, "last": b} for a, b in fold(*row, **options)] for row in zip(*(c.to_pylist() for c in columns), strict=True)]
        return pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return F.arrow_udf(run, "array<struct<first:int,last:int>>")


def pack_blocks(words: Column, target: int = TARGET_WORDS) -> Column:
    """Inclusive ranges of sentences as ``packed_ranges`` finds them."""
    return _ranges(packed_ranges, target=target)(words)


def merge_small(bounds: Column, words: Column, least: int = MIN_WORDS) -> Column:
    """Boundaries (of type ``BOUNDS``) merged as ``merged_ranges`` says: first place, last end, all headers."""

    def one(r: Column) -> Column:
        first = F.get(bounds, r["first"])
        headers = F.transform(F.slice(bounds, r["first"] + 1, r["last"] - r["first"] + 1), lambda b: b["header"])
        return F.struct(first["block"].alias("block"), first["pos"].alias("pos"), first["start"].alias("start"), F.get(bounds, r["last"])["end"].alias("end"), F.array_join(headers, "; ").alias("header"))

    return F.transform(_ranges(merged_ranges, least=least)(bounds["start"], bounds["end"], words), one)


def block_rows(lists: DataFrame, key: str, target: int = TARGET_WORDS) -> DataFrame:
    """(key, block, first, last) of the packed blocks of ``sentence_lists``."""
    return lists.select(key, F.posexplode(pack_blocks(F.col("words"), target)).alias("block", "b")).select(key, "block", "b.*")


def boundary_requests(lists: DataFrame, key: str, target: int = TARGET_WORDS) -> DataFrame:
    """(key, block, offset, n, numbered): the sentences of each block, numbered from 0 within it."""

    def request(b: Column) -> Column:
        inside = F.slice("sentences", b["first"] + 1, b["last"] - b["first"] + 1)
        numbered = F.array_join(F.transform(inside, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")
        return F.struct(b["first"].alias("offset"), (b["last"] - b["first"] + 1).alias("n"), numbered.alias("numbered"))

    made = F.transform(pack_blocks(F.col("words"), target), request)
    return lists.select(key, F.posexplode(made).alias("block", "r")).select(key, "block", "r.*")


def parse_boundaries(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """(key, block, pos, start, end, header) in document positions; a block whose reply cannot be read is one boundary."""
    joined = requests.join(replies.select(key, "block", "response"), [key, "block"], "left")
    chunks = F.from_json(reply_body(F.col("response")), BOUNDARY_REPLY)["chunks"]
    offset = F.col("offset")
    usable = chunks.isNotNull() & F.forall(chunks, lambda c: c["start_sentence"].isNotNull() & c["end_sentence"].isNotNull())
    read = F.transform(chunks, lambda c: F.struct((c["start_sentence"] + offset).alias("start"), (c["end_sentence"] + offset).alias("end"), F.coalesce(c["header"], F.lit("")).alias("header")))
    whole = F.array(F.struct(offset.alias("start"), (offset + F.col("n") - 1).alias("end"), F.lit(FALLBACK_HEADER).alias("header")))
    return joined.select(key, "block", F.posexplode(F.when(usable, read).otherwise(whole)).alias("pos", "b")).select(key, "block", "pos", "b.*")


def boundary_lists(boundaries: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, sentences, words, bounds): the boundaries of a document in order beside its sentences, which travel once however many there are.

    ``boundaries`` has block, pos, start, end, header.
    """
    bounds = F.array_sort(F.collect_list(F.struct("block", "pos", "start", "end", "header"))).cast(BOUNDS)
    return lists.join(boundaries.groupBy(key).agg(bounds.alias("bounds")), key)


def merged_boundaries(listed: DataFrame, key: str, least: int = MIN_WORDS) -> DataFrame:
    """``listed`` (``boundary_lists``) after small boundaries took in their followers, across the blocks of a document."""
    return listed.withColumn("bounds", merge_small(F.col("bounds"), F.col("words"), least))


def boundary_texts(listed: DataFrame, key: str) -> DataFrame:
    """(key, place, block, pos, start, end, header, chunk): sentences start..end joined by blanks, in order; gaps drop text and overlaps repeat it."""

    def made(b: Column) -> Column:
        first = F.greatest(b["start"], F.lit(0))
        text = F.array_join(F.slice("sentences", first + 1, F.greatest(b["end"] - first + 1, F.lit(0))), " ")
        return F.struct(*[b[c].alias(c) for c in ("block", "pos", "start", "end", "header")], text.alias("chunk"))

    return listed.select(key, F.posexplode(F.transform("bounds", made)).alias("place", "made")).select(key, "place", "made.*")


def chunk_semantically(docs: DataFrame, replies: DataFrame, key: str, text: str = "text", target: int = TARGET_WORDS, least: int = MIN_WORDS) -> DataFrame:
    """(key, chunk_index, header, chunk) with the boundaries of ``replies`` (key, block, response)."""
    lists = sentence_lists(docs, key, text)
    found = parse_boundaries(boundary_requests(lists, key, target), replies, key)
    return boundary_texts(merged_boundaries(boundary_lists(found, lists, key), key, least), key).select(key, F.col("place").alias("chunk_index"), "header", "chunk")


def embed_text(header, chunk):
    """What the embedding model gets: the chunk, after its header where there is one."""
    return F.when(header.isNull(), chunk).otherwise(F.concat(header, F.lit("\n\n"), chunk))
