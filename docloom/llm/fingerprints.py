"""Document fingerprints: a canonical exact digest, with DataFrame functions only.

The canonical form of a text is its Unicode composition (NFC) with case folded (so that ``ß`` is ``ss`` and both small sigmas are one), runs of white space folded to
one space and none at the ends. Documents are grouped by a wide (2 x 64 bit) xxhash of it. Where a group has
several members their canonical bytes are compared; should different texts share a hash, each text of such
a group gets its rank among them as a suffix, so equal fingerprints of documents always mean equal canonical texts. An edited
text is compared byte by byte with its document, and takes the rank of a text of such a group that it equals.

Each text is made canonical once on its way to its neighbours, and once more only to compare the bytes of groups with several members.

Hot groups: groups are counted and compared by aggregates that combine on the map side; members are never
collected. Neighbours meet in ranges of ids of about ``RANGE_BYTES`` of text.

Defined cases: null text counts as the empty text; equal texts have equal fingerprints; rows that repeat
an id stand in the order of the hash of their text, in one range; null ids stand after every other, in the same order, in as many ranges as they need; ids that are no numbers are refused; an empty table gives
an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import discard, materialise

#: Groups with several members are broadcast up to this many, 16 bytes each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text of a range of ids, the most ranges, and ids sampled for each. Ranges are small, so that tasks get many and about as much each.
RANGE_BYTES, RANGES, SAMPLED_IDS = 512 << 10, 250_000, 8
#: Bytes of text of the ranges that a task takes, so that tasks grow in number with the input, not in size.
TASK_BYTES = 16 << 20


def canonical(text: Column) -> Column:
    """Composed, case-folded, with single blanks. Spark has no function for the first two but ``lower``, which is the same on ASCII."""
    plain = F.coalesce(text, F.lit(""))

    def composed(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(plain), F.lit(True))
    folded = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(composed(folded))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> list[Column]:
    return [F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit("wide"), canon).alias("h2")]


def digest(h1: Column, h2: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (h1, h2)])


def collided(docs: DataFrame, hashes: DataFrame, text: str = "text") -> DataFrame | None:
    """(h1, h2, canon, rank) of every canonical text whose wide hash another canonical text shares; None if there is none, as a rule. ``hashes`` has (h1, h2) of every document."""
    canon = docs.select(canonical(F.col(text)).alias("canon")).select("canon", *wide_hash(F.col("canon")))
    several = materialise(hashes.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "several")
    few = several.count() <= BROADCAST_ROWS
    members = canon.join(F.broadcast(several) if few else several, ["h1", "h2"], "left_semi")
    least_most = members.groupBy("h1", "h2").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    differ = materialise(least_most.where("least <> most").select("h1", "h2"), "differ")
    discard(several)
    if differ.isEmpty():
        discard(differ)
        return None
    each = canon.join(differ, ["h1", "h2"], "left_semi").distinct()
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")))


def add_fingerprints(rows: DataFrame, columns: dict[str, str], ties: DataFrame) -> DataFrame:
    """``rows`` with, for each text column, its fingerprint under the given name; ``ties`` as ``collided`` gives them."""
    for text, name in columns.items():
        known = ties.select("h1", "h2", F.col("canon").alias("_canon"), F.concat(digest(F.col("h1"), F.col("h2")), F.lit("-"), F.col("rank").cast("string")).alias("_ranked"))
        hashed = rows.withColumn("_canon", canonical(F.col(text))).select("*", *wide_hash(F.col("_canon")))
        found = hashed.join(known, ["h1", "h2", "_canon"], "left")
        rows = found.withColumn(name, F.coalesce("_ranked", digest(F.col("h1"), F.col("h2")))).drop("h1", "h2", "_canon", "_ranked")
    return rows


def with_next(docs: DataFrame, value: str, id_col: str = "doc_id") -> DataFrame:
    """(id, value, h1, h2, bucket, tie, copy, following, following_h1, following_h2): each row with the wide hash of its canonical form and, in ``following``, the value of the next lower id; after the last, of the first.

    Ids are dealt into ranges of about ``RANGE_BYTES`` by a hash sample of bounded size; null ids, which come last, by the hash of their
    text, which orders them. The head of the next range is copied to the end of
    each range (``copy``), so every range finds its neighbours on its own. Tasks take about ``TASK_BYTES`` of ranges.
    """
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        raise TypeError(f"{id_col} must be a number")
    rows = docs.select(F.col(id_col).alias("id"), F.col(value).alias("value")).withColumn("tie", F.xxhash64("value"))
    rows = rows.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(-1e300) + F.col("tie") * 1e280))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(value)), F.lit(0))).first()
    context = docs.sparkSession.sparkContext
    ranges = min(RANGES, max(context.defaultParallelism, -(-size // RANGE_BYTES)))
    every = max(1, n // (SAMPLED_IDS * ranges))
    sample = rows.where(F.pmod(F.xxhash64("id", "tie"), F.lit(every)) == 0).select("at", (F.octet_length("value") + 1).alias("size"))
    splits = [float("-inf"), *(cuts_of(sorted(map(tuple, sample.collect())), ranges) or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(rows).withColumn("bucket", F.col("range").cast("int"))
    heads = rows.groupBy("bucket").agg(F.max("at").alias("head"))
    order = Window.orderBy(F.desc("bucket"))
    ring = heads.select("bucket", "head", F.lag("bucket").over(order).alias("above"), F.min("bucket").over(Window.partitionBy()).alias("last"))
    target = ring.select("bucket", "head", F.coalesce("above", "last").alias("target"))
    copies = rows.alias("r").join(F.broadcast(target.alias("t")), (F.col("r.bucket") == F.col("t.bucket")) & (F.col("r.at") == F.col("t.head")))
    both = rows.select("id", "value", "tie", "bucket", F.lit(False).alias("copy")).unionByName(copies.select("r.id", "r.value", "r.tie", F.col("t.target").alias("bucket"), F.lit(True).alias("copy")))
    hashed = both.withColumn("canon", canonical(F.col("value"))).select(*both.columns, *wide_hash(F.col("canon")))
    dealt = hashed.repartition(min(ranges, max(context.defaultParallelism, -(-size // TASK_BYTES))), "bucket")
    within = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("id"), F.desc("tie"))
    return dealt.select("*", *[F.lead(c).over(within).alias(name) for c, name in (("value", "following"), ("h1", "following_h1"), ("h2", "following_h2"))])


def cuts_of(sample: list[tuple[float, int]], ranges: int) -> list[float]:
    """Places among the sorted (place, size) that cut them into ranges of equal size."""
    share = max(1, sum(size for _, size in sample) // ranges)
    before = accumulate((size for _, size in sample), initial=0)
    return sorted({at for (at, size), n in zip(sample, before, strict=False) if n // share != (n + size) // share})


def op9_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``documents``.

    The edited text has its last half replaced by as many code points of the next document, by descending id.
    Likeness is 1 where fingerprints (of an edited text, canonical bytes) are equal, else 0: the digest is exact.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.char_length("value") / 2).cast("int")
    edited = F.concat(F.substring("value", F.lit(1), F.char_length("value") - half), F.substring("following", F.lit(1), half))
    rows = with_next(texts, "text").where("NOT copy").withColumn("edited", edited)
    hashed = rows.withColumn("canon", canonical(F.col("edited"))).select("*", F.struct(*wide_hash(F.col("canon"))).alias("e"))
    same = (F.col("h1") == F.col("e.h1")) & (F.col("h2") == F.col("e.h2")) & (canonical(F.col("value")) == F.col("canon"))
    written = materialise(
        hashed.select(
            F.col("id").alias("doc_id"), F.char_length("value").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "h1", "h2", "e", "following_h1", "following_h2", same.cast("double").alias("near_edited"),
        ),
        "fingerprints",
    )
    ties = collided(texts, written.select("h1", "h2"))
    if ties is not None:
        discard(written)
        return ranked(rows, ties)
    own, following = digest(F.col("h1"), F.col("h2")), digest(F.col("following_h1"), F.col("following_h2"))
    near_next = (own == following).cast("double").alias("near_next")
    return written.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), digest(F.col("e.h1"), F.col("e.h2")).alias("edited_fingerprint"), "near_edited", near_next)


def ranked(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """The result where different canonical texts share a wide hash: ``rows`` (id, value, following, edited) meet the ranks of those texts."""
    columns = {"value": "fingerprint", "edited": "edited_fingerprint", "following": "next_fingerprint"}
    found = add_fingerprints(rows.drop("h1", "h2", "following_h1", "following_h2"), columns, ties)
    return found.select(
        F.col("id").alias("doc_id"), F.char_length("value").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", (canonical(F.col("value")) == canonical(F.col("edited"))).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
