"""Cosine top-k for a table of questions, similarity cut-off, context expansion, approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CANDIDATES, MAX_CORPUS_SHARE = 20, 0.5
MIN_SIMILARITY, MAX_DROP, RADIUS = 0.65, 0.10, 1
#: Questions are broadcast up to this size; more meet the chunks in cells of so many chunks and this size of questions.
QUERY_BYTES, CELL_ROWS = 64 << 20, 50_000
#: Questions that a task holds candidates of, and similarities that it computes at a time.
SHARED_QUESTIONS, SCORED = 2048, 1 << 21
FOUND = "query_id bigint, user_id int, source string, chunk_index int, chunk_id bigint, similarity double"
FOUND_COLUMNS = [part.split()[0] for part in FOUND.split(", ")]
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("user_id", pa.int32()), ("source", pa.string()), ("chunk_index", pa.int32()), ("chunk_id", pa.int64()), ("similarity", pa.float64())])
#: So many users with questions become a filter on the chunk table.
LISTED_USERS = 1000
#: Places that context expansion broadcasts at most; more are joined by a shuffle.
BROADCAST_PLACES = 1_000_000


def corpus_size(chunks: DataFrame, queries: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, corpus) with the number of chunks of the question's user, 0 if there are none; ``few`` questions let the scan leave out other users."""
    sizes = asked_users(chunks.select("user_id"), queries, few).groupBy("user_id").agg(F.count(F.lit(1)).alias("corpus"))
    return queries.select("query_id", "user_id").join(sizes, "user_id", "left").select("query_id", F.coalesce("corpus", F.lit(0)).alias("corpus"))


def candidate_limit(corpus):
    """Half of the corpus, at most 20 and at least 1."""
    share = F.floor(corpus * MAX_CORPUS_SHARE)
    return F.greatest(F.least(F.lit(MAX_CANDIDATES), share), F.lit(1)).cast("int")


def top_k(chunks: DataFrame, queries: DataFrame, skip_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, user_id, rank, source, chunk_index, chunk_id, similarity): the best chunks of each question's user.

    ``chunks``: user_id, source, chunk_index, embedding and, for ``skip_self``, the id that equals query_id.
    The limit depends on the size of the user's corpus. Up to ``SHARED_QUESTIONS`` questions of up to ``query_bytes`` are broadcast, so that
    vectors are never shuffled and, on a table partitioned by user, other users' partitions are not read; every task keeps the best of each question before candidates meet by question.
    More questions than that meet the chunks in cells of bounded size on the executors (``best_of_cells``).
    Similarity is half of one plus the cosine; vectors of length zero or of another dimension are no
    candidates. Ties go by source and chunk_index.
    """
    narrow = chunks.select(F.col("user_id").cast("int").alias("user_id"), "source", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("user_id").cast("int").alias("user_id"), "embedding").where("embedding IS NOT NULL")
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    few = n * max(dim or 1, 1) * 8 <= query_bytes and n <= SHARED_QUESTIONS
    limits = corpus_size(chunks, queries, few).withColumn("k", candidate_limit(F.col("corpus"))).select("query_id", "k")
    narrow = asked_users(narrow, asked, few)
    found = best_of_batches(narrow, asked, skip_self) if few else best_of_cells(narrow, asked, skip_self, max(1, min(SHARED_QUESTIONS, query_bytes // (8 * max(dim, 1)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source", "chunk_index", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CANDIDATES)
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("k")).drop("k")


class Best:
    """The best chunks of each question so far, in the order of ranks: never more than ``most``, whatever ties there are.

    Ties of similarity go by (source, chunk_index, chunk_id), nulls first, as the ranks do. A question with all its places taken looks only at what is as good as its last.
    """

    def __init__(self, most: int = MAX_CANDIDATES):
        self.most = most
        self.rows: dict[int, list[tuple]] = {}

    def add(self, question: int, similarity: np.ndarray, at: np.ndarray, describe: Callable[[np.ndarray], list[tuple]]) -> None:
        """Take in the rows ``at`` with their similarities; ``describe`` gives (user_id, source, chunk_index, chunk_id) of places."""
        held = self.rows.get(question, [])
        usable = np.flatnonzero(similarity >= (held[-1][0] if len(held) == self.most else -np.inf))
        if len(usable) > self.most:
            least = np.partition(similarity[usable], -self.most)[-self.most]
            better, equal = usable[similarity[usable] > least], usable[similarity[usable] == least]
            # Of very many equal ones only the first in order can stay; they are named in blocks.
            first: list[tuple] = []
            for k in range(0, len(equal), 4096):
                part = equal[k : k + 4096]
                first = sorted([*first, *zip(map(order_of, rows := describe(at[part])), rows, strict=True)], key=itemgetter(0))[: self.most - len(better)]
            named = [(float(s), row) for s, row in zip(similarity[better], describe(at[better]), strict=True)] + [(float(least), row) for _, row in first]
        else:
            named = [(float(s), row) for s, row in zip(similarity[usable], describe(at[usable]), strict=True)]
        if named:
            self.rows[question] = sorted([*held, *named], key=lambda r: (-r[0], order_of(r[1])))[:self.most]

    def batch(self) -> pa.RecordBatch:
        found = [(question, *row, similarity) for question, rows in self.rows.items() for similarity, row in rows]
        return pa.RecordBatch.from_pylist([dict(zip(FOUND_COLUMNS, r, strict=True)) for r in found], FOUND_ARROW)


def order_of(row: tuple) -> tuple:
    """The order of ties: source by its bytes, chunk_index, chunk_id; nulls first."""
    _, source, index, chunk = row
    return (source is not None, (source or "").encode("utf-8", "surrogatepass"), index is not None, index or 0, chunk is not None, chunk or 0)


def score_block(best: Best, vectors: np.ndarray, at: np.ndarray, ids: np.ndarray, wanted: np.ndarray, names: list[int], describe: Callable, skip_self: bool, near: Callable[[int], np.ndarray] | None = None) -> None:
    """Take the chunks ``at`` with their ``vectors`` into ``best`` for the questions ``names``, about ``SCORED`` similarities at a time; ``near`` says of a question which of them count."""
    points, step = unit(vectors.astype(np.float64)), max(1, SCORED // max(1, len(at)))
    for first in range(0, len(names), step):
        similarity = (1 + points @ wanted[first : first + step].T) / 2
        for q, name in enumerate(names[first : first + step]):
            s = similarity[:, q]
            usable = ~np.isnan(s) & (ids != name) if skip_self else ~np.isnan(s)
            if near is not None:
                usable &= near(first + q)
            best.add(name, s[usable], at[usable], describe)


def described(batch: pa.RecordBatch) -> Callable[[np.ndarray], list[tuple]]:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("user_id", "source", "chunk_index", "chunk_id")]
    return lambda places: list(zip(*[c.take(pa.array(places, pa.int64())).to_pylist() for c in columns], strict=True)) if len(places) else []


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of the vectors of a batch, where each begins, and how many it has (-1 for none)."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    starts = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), starts, np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), -1)


def asked_users(chunks: DataFrame, queries: DataFrame, few: bool) -> DataFrame:
    """The chunks of users with questions, where the questions are ``few``: of a table partitioned by user the other partitions are not read.

    Up to ``LISTED_USERS`` are a filter of their own; more are sent along to a semi-join. With many questions the chunks stay as they are.
    """
    if not few:
        return chunks
    users = queries.select("user_id").where("user_id IS NOT NULL").distinct()
    listed = [r[0] for r in users.limit(LISTED_USERS + 1).collect()]
    if len(listed) <= LISTED_USERS:
        return chunks.where(F.col("user_id").isin(listed))
    return chunks.join(F.broadcast(users), "user_id", "left_semi").select(*chunks.columns)


def best_of_batches(chunks: DataFrame, queries: DataFrame, skip_self: bool) -> DataFrame:
    """Candidates of each task: a bounded list per question is carried over its batches, so ties and one frequent vector cost no more than others."""
    shared = chunks.sparkSession.sparkContext.broadcast([tuple(r) for r in queries.collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_user: dict[tuple, tuple[list, list]] = {}
        for query_id, user, vector in shared.value:
            vectors, names = by_user.setdefault((user, len(vector)), ([], []))
            vectors.append(vector)
            names.append(query_id)
        units = {k: (unit(np.array(v, np.float64)), names) for k, (v, names) in by_user.items()}
        best = Best()
        for batch in batches:
            flat, starts, sizes = vectors_of(batch)
            users = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            for (user, size), (wanted, names) in units.items():
                at = np.flatnonzero((users == user) & (sizes == size)) if user is not None else []
                if len(at):
                    score_block(best, flat[starts[at][:, None] + np.arange(size)], at, ids[at], wanted, names, described(batch), skip_self)
        yield best.batch()

    return chunks.mapInArrow(search, FOUND)


def best_of_cells(chunks: DataFrame, queries: DataFrame, skip_self: bool, block: int, cell: int = CELL_ROWS, near: Callable[[np.ndarray, np.ndarray], Callable[[int], np.ndarray]] | None = None, most: int = MAX_CANDIDATES) -> DataFrame:
    """Candidates of each cell: ``block`` questions of a user against about ``cell`` of its chunks, ``near`` of them where it is given.

    A user's questions are copied once for every range of its chunks and its chunks once for every block of its questions; a user with
    many of both is many cells, and no cell grows with the tables.
    """
    asked = queries.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    stored = chunks.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("ranges"))
    sizes = F.broadcast(asked.join(stored, "user_id"))  # a shuffle by user would bring all chunks of a user to one task
    left = chunks.where("embedding IS NOT NULL").join(sizes, "user_id").withColumn("range", F.pmod(F.xxhash64("source", "chunk_index", "chunk_id"), F.col("ranges")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "ranges")
    right = queries.join(sizes, "user_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    right = right.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).drop("blocks", "ranges")

    def search(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best, sizes = Best(most), stored["embedding"].map(len).to_numpy()
        columns = [[None if pd.isna(v) else v for v in stored[c].tolist()] for c in ("user_id", "source", "chunk_index", "chunk_id")]
        for dim, part in asked.groupby(asked["embedding"].map(len)):
            at = np.flatnonzero(sizes == dim)
            if len(at):
                wanted = unit(np.array(part["embedding"].tolist(), np.float64))
                rows = np.array(stored["embedding"].iloc[at].tolist())
                counts = None if near is None else near(rows, wanted)
                score_block(best, rows, at, stored["chunk_id"].to_numpy()[at], wanted, part["query_id"].tolist(), lambda places: [tuple(c[k] for c in columns) for k in places.tolist()], skip_self, counts)
        return best.batch().to_pandas()

    keys = ["user_id", "block", "range"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN for rows of length zero."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def cut_off(candidates: DataFrame, min_similarity: float = MIN_SIMILARITY, max_drop: float = MAX_DROP) -> DataFrame:
    """The prefix of each question's candidates before the first weak one or large drop, with ``low_confidence``.

    The first always stays; it is of low confidence if it is itself below the threshold.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    before = F.lag("similarity").over(order)
    stop = before.isNotNull() & ((F.col("similarity") < min_similarity) | (before - F.col("similarity") > max_drop) | (F.first("similarity").over(order) < min_similarity))
    marked = candidates.withColumn("_stop", stop.cast("int")).withColumn("low_confidence", F.first("similarity").over(order) < min_similarity)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("_stops", F.sum("_stop").over(upto)).where("_stops = 0").drop("_stop", "_stops")


def low_confidence(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, low_confidence) of every question; true where nothing was found."""
    flags = kept.groupBy("query_id").agg(F.bool_or("low_confidence").alias("low_confidence"))
    return queries.select("query_id").join(flags, "query_id", "left").select("query_id", F.coalesce("low_confidence", F.lit(True)).alias("low_confidence"))


def expand_context(hits: DataFrame, chunks: DataFrame, radius: int = RADIUS, most_hits: int | None = None) -> DataFrame:
    """Hits and their neighbours within ``radius`` in the same user's source; neighbours have similarity 0.

    Neighbour keys are made by ``sequence`` and met by an equi-join, which shuffles evenly where a range join
    would not. Where ``most_hits``, a bound on the hits, keeps the keys under ``BROADCAST_PLACES``, they are broadcast and the
    chunk table stays where it is. Of several stored rows of one place the latest counts. Radius 0 gives the hits as they are.
    """
    if radius <= 0:
        return hits
    around = hits.select("query_id", "user_id", "source", F.col("chunk_index").alias("hit"), "similarity", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    own = F.when(F.col("hit") == F.col("chunk_index"), F.col("similarity")).otherwise(F.lit(0.0))
    places = around.groupBy("query_id", "user_id", "source", "chunk_index").agg(F.max(own).alias("similarity"))
    keys = places.select("user_id", "source", "chunk_index").distinct()
    few = most_hits is not None and most_hits * (2 * radius + 1) <= BROADCAST_PLACES
    stored = asked_users(chunks, hits, few).join(F.broadcast(keys) if few else keys, ["user_id", "source", "chunk_index"])
    latest = stored.groupBy("user_id", "source", "chunk_index").agg(F.max_by(F.struct("chunk", "header"), F.struct("file_mtime", "chunk_id")).alias("row"))
    return places.join(latest, ["user_id", "source", "chunk_index"]).select("query_id", "user_id", "source", "chunk_index", "similarity", "row.*")


def file_search(candidates: DataFrame, limit: int = 10, digits: int = 4, pool: int | None = None) -> DataFrame:
    """Files of each question by their best chunk: similarity, the rank of that chunk, candidate count, all files found.

    ``pool`` cuts the candidates by rank first.
    """
    used = candidates if pool is None else candidates.where(F.col("rank") <= pool)
    files = used.groupBy("query_id", "source").agg(F.max("similarity").alias("best"), F.min_by("chunk_id", "rank").alias("best_chunk"), F.count(F.lit(1)).alias("chunk_count"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "source")
    counted = files.withColumn("total_files", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).withColumn("place", F.row_number().over(order))
    return counted.where(F.col("place") <= limit).select("query_id", "place", "source", F.round("best", digits).alias("similarity"), "best_chunk", "chunk_count", "total_files")


def hyperplane_codes(vectors: np.ndarray, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    """The bucket of each vector in each table: the signs against ``bits`` random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
    return (vectors.astype(np.float64) @ planes >= 0).reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int32))


def sharing_buckets(tables: int, bits: int) -> Callable[[np.ndarray, np.ndarray], Callable[[int], np.ndarray]]:
    """For ``best_of_cells``: the chunks that lie in the bucket of a question, or in one that differs in one sign, in some table."""

    def near(chunks: np.ndarray, questions: np.ndarray) -> Callable[[int], np.ndarray]:
        stored, asked = np.ascontiguousarray(hyperplane_codes(chunks, tables, bits).T), hyperplane_codes(questions, tables, bits)

        def met(q: int) -> np.ndarray:
            found = np.zeros(stored.shape[1], bool)
            for table in range(tables):
                differ = stored[table] ^ asked[q, table]
                found |= differ & (differ - 1) == 0
            return found

        return met

    return near


def approximate_top_k(chunks: DataFrame, queries: DataFrame, k: int = MAX_CANDIDATES, tables: int = 16, bits: int = 6, skip_self: bool = False) -> DataFrame:
    """Like ``top_k`` with a fixed k, but only chunks that share a hyperplane bucket of the user count.

    Questions also look into the buckets next to theirs. More tables raise the recall; with these defaults neighbours at a
    cosine of 0.25 are found with a probability of about 0.97. So many pairs share a bucket somewhere that a row for each would be far more than
    the vectors: they meet in cells of bounded size, where codes are compared and only the best stay.
    """
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    stored = chunks.where(F.size("embedding") == dim).select(F.col("user_id").cast("int").alias("user_id"), "source", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding")
    asked = queries.where(F.size("embedding") == dim).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("user_id").cast("int").alias("user_id"), "embedding")
    found = best_of_cells(stored, asked, skip_self, SHARED_QUESTIONS, near=sharing_buckets(tables, bits), most=k)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source", "chunk_index", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "user_id", "source", "chunk_index", "chunk_id", "similarity", "rank")


def cosine(a, b):
    """Cosine of two vector columns in double precision; null where one has length zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
