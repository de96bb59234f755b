"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run holds line keys (as 128-bit hashes) with the number of documents that hold them; it is a table bucketed by key, each bucket sorted. Documents
come in batches by descending ranges of their ids. Each batch is counted by key and merge-anti-joined against the runs: keys that no run owns
form a run of the batch's own, at level 0, and as no later batch has a larger id, the largest id of the batch is the document that keeps the
line. Keys that a run owns are only counted: they go with the batch as additions, and no more once their owner's count alone is enough.
When a level holds ``fanout`` runs they are compacted into one of the next level, where additions meet their owners, so a key is rewritten a logarithmic number
of times. A key has one owner at any time, and the owner alone says which document keeps the line; its count is the owner's with the additions not yet compacted.
Runs have as many buckets as a shuffle has partitions, so the join neither shuffles nor sorts them; a compaction shuffles what it merges.
They lie in the shared folder; a run is written whole before it is named, so a lost executor
or a repeated task leaves no partial run, and what a compaction has replaced is deleted.

Hot lines: a run is built by a count per (line, document) and then per line, both combined on the map side,
and the join with the repeated lines is a sort-merge join of which Spark splits the large partitions; no line's documents are
ever collected. Lines return to their documents as positions, and a document is rewritten by one array
difference, linear in its lines.

Defined cases: null or empty text is one empty line; lines whose key is shorter than ``min_chars`` stay; a
key repeated within one document counts once; rows that repeat a document id are one document, whose lines
are counted together and rewritten row by row; a null id is a document below every other; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, free_name, materialise
from docloom.sources.sorted_tables import SortedTable, ordered_scans, write_sorted

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 3
#: Bytes of text of a batch, and the least number of batches. A batch is worked off by all executors, so it may be large.
BATCH_BYTES, BATCHES = 4 << 40, 4
#: The keys of a batch are spread over so many hash slots.
SLOTS = 4096
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case. ``lower`` does the same, faster, on lines whose only capitals are A-Z."""
    bare = F.trim(line, F.lit(BLANKS))
    others = bare.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]") & (F.octet_length(bare) > F.length(bare))
    return F.when(others, F.translate(bare, UPPER, LOWER)).otherwise(F.lower(bare))


def keyed_lines(docs: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of every line that is long enough; ``row`` tells texts of one id apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keys = rows.where(F.length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


@dataclass
class LineRuns:
    """The levelled runs: ``levels[k]`` lists the tables of level k, with (h1, h2, n_docs, last_id, owned); rows that are not owned are additions.

    ``enough`` is the count from which an owner needs no additions; without it counts are exact. Batches must come by descending ranges of ids.
    """

    spark: SparkSession
    fanout: int = FANOUT
    enough: int | None = None
    levels: list[list[SortedTable]] = field(default_factory=list)

    def tables(self) -> list[SortedTable]:
        return [table for level in self.levels for table in level]

    def rows(self) -> DataFrame | None:
        tables = self.tables()
        return union(tables) if tables else None

    def unseen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) with ``owned``: whether no run holds the key, so that it becomes the batch's own. A merge join with each run tells; keys that have enough go."""
        found = keys.select("*", F.lit(False).alias("seen"), F.lit(False).alias("full"))
        for table in self.tables():
            held = table.read().where("owned").select(*KEY, F.lit(True).alias("held"), (F.lit(False) if self.enough is None else F.col("n_docs") >= self.enough).alias("plenty"))
            met = found.join(held.hint("merge"), KEY, "left")
            found = met.select(*keys.columns, (F.col("seen") | F.col("held").isNotNull()).alias("seen"), (F.col("full") | F.coalesce("plenty", F.lit(False))).alias("full"))
        return found.where(~F.col("full")).select(*keys.columns, (~F.col("seen")).alias("owned"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (id, h1, h2): documents whose ids are all less than those of earlier batches."""
        once = keys.select(*KEY, "id").distinct()
        counts = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_id"))
        with ordered_scans(self.spark):
            self._put(0, self.unseen(counts))

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels[level].append(write_sorted(rows, "line-run", KEY, KEY, buckets, dealt=True))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, compacted(union(full)))
            for table in full:
                table.discard()

    def clear(self) -> None:
        """Delete all runs."""
        for table in self.tables():
            table.discard()
        self.levels = []

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, last_id) of every key: owners with their additions."""
        return compacted(self.rows()).drop("owned")


def union(tables: list[SortedTable]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table.plain() for table in tables])


def compacted(rows: DataFrame) -> DataFrame:
    """Owners with their additions; the id is the owner's."""
    owner = F.min(F.when(F.col("owned"), F.col("last_id"))).alias("last_id")
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), owner, F.bool_or("owned").alias("owned"))


def batches_for(docs: DataFrame, text: str) -> int:
    return max(BATCHES, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BATCH_BYTES))


def id_cuts(docs: DataFrame, id_col: str, batches: int, sample: int = 4096) -> list:
    """Up to ``batches`` - 1 ids, descending, that divide the rows about evenly: from the ids of a bounded sample by hash."""
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").select("id", F.xxhash64("id").alias("dealt"))
    some = sorted({r["id"] for r in ids.orderBy("dealt", "id").limit(sample).collect()}, reverse=True)
    return sorted({some[k * len(some) // batches] for k in range(1, batches)}, reverse=True) if some else []


def batch_of(cuts: list) -> Column:
    """The number of the range of an id: the largest ids have 0, null ids the last."""
    return reduce(lambda n, cut: n + F.coalesce(F.col("id") <= F.lit(cut), F.lit(True)).cast("int"), cuts, F.lit(0))


def dedup_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with ``text`` rewritten and, last, a struct of its own: n_lines before and n_dropped.

    Lines whose key is in at least ``min_docs`` documents stay in the one of the largest id only. The table
    is dealt into ``batches`` by descending ranges of ids (as many as its bytes need where none are given), each added to the runs in turn.
    """
    cuts = id_cuts(docs, id_col, batches or batches_for(docs, text))
    batches = len(cuts) + 1
    dealt = keyed_lines(docs, text, id_col, min_chars).withColumn("batch", batch_of(cuts))
    keys = materialise(dealt.repartition("batch", F.pmod(F.col("h1"), F.lit(SLOTS)), F.pmod(F.xxhash64("id"), F.lit(SLOTS))), "line-keys", "batch")
    store = LineRuns(docs.sparkSession, fanout, min_docs)
    for k in range(batches):
        store.add(keys.where(F.col("batch") == k))
    # Written, so that both sides of the join are exchanges of their own and Spark can split a hot line.
    repeated = materialise(store.counts().where(F.col("n_docs") >= min_docs).select(*KEY, "last_id"), "repeated-lines")
    store.clear()
    gone = keys.join(repeated, KEY).where(~F.col("id").eqNullSafe(F.col("last_id")))
    per_row = gone.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))

    name, lines = free_name(docs, "lines"), split_lines(F.col(f"d.{text}"))
    positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone"))
    kept = F.when(F.col("g.gone").isNull(), F.col(f"d.{text}")).otherwise(F.array_join(F.transform(positions, lambda i: F.get(lines, i)), "\n"))
    counts = F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("g.row"))
    out = [kept.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(per_row.alias("g"), same, "left").select(*out, counts.alias(name))


def rewrite_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` with repeated lines dropped from ``text`` and ``n_chars`` counted anew."""
    found = dedup_lines(docs, text, id_col)
    return found.select(*[F.length(text).cast("bigint").alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``documents``."""
    found = dedup_lines(docs.select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", digest)


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
w AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, last_id IS NOT NULL AND doc_id <> last_id AS gone FROM k LEFT JOIN w USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
