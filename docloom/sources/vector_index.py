"""A stored approximate index: chunks in partitions by their nearest coarse centroid, of which a question reads only its probes.

Centroids are fitted once on a bounded sample of vectors (spherical k-means); every chunk is stored. A question goes to the partitions of
its nearest centroids, where all chunks of its user are scored exactly. How many it needs for the recall that is wanted depends on
how much the vectors cluster, so it is measured on the sample when the index is written, and stored. Partitions are files of bounded size, so one vector that very many
chunks have is one partition of many files, and each task keeps a bounded list per question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import FOUND, MAX_CANDIDATES, SCORED, SHARED_QUESTIONS, Best, described, score_block, unit, vectors_of

#: Vectors that centroids are fitted on: those whose ids hash lowest.
SAMPLE_ROWS, STEPS = 20_000, 10
#: Vectors of the sample that ask for their neighbours, and the share of these that the probes must reach.
ASKED_ROWS, RECALL = 500, 0.95
ROWS_PER_FILE = 200_000
COLUMNS = ["user_id", "source", "chunk_index", "chunk_id", "embedding"]
STORED = "user_id int, source string, chunk_index int, chunk_id bigint, embedding array<float>, cell int"


def sampled(chunks: DataFrame, dim: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Users and unit vectors of up to ``rows`` chunks by hash, without vectors of length zero."""
    dealt = F.xxhash64("chunk_id", "source", "chunk_index").alias("dealt")
    some = chunks.where(F.size("embedding") == dim).select("user_id", "embedding", dealt).orderBy("dealt").limit(rows).collect()
    points = unit(np.array([r["embedding"] for r in some], np.float64).reshape(-1, dim))
    users = np.array([-1 if r["user_id"] is None else r["user_id"] for r in some], np.int64)
    usable = ~np.isnan(points).any(axis=1)
    return users[usable], points[usable]


def nearest_of(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of each point's nearest centroid, about ``SCORED`` products at a time."""
    step = max(1, SCORED // max(1, len(centers)))
    return np.concatenate([np.empty(0, np.int64), *((points[k : k + step] @ centers.T).argmax(axis=1) for k in range(0, len(points), step))])


def fit_centroids(points: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """``cells`` unit vectors, or as many as there are different points."""
    distinct = np.unique(points, axis=0)
    if len(distinct) == 0:
        return points[:0]
    chance = np.random.default_rng(seed)
    centers = distinct[chance.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(STEPS):
        nearest = nearest_of(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        moved = unit(sums)
        centers = np.where(np.isnan(moved), centers, moved)
    return centers


def probes_needed(users: np.ndarray, points: np.ndarray, centers: np.ndarray, recall: float = RECALL, asked: int = ASKED_ROWS) -> int:
    """The fewest partitions in which the given share of the nearest chunks of the same user lies, as the sample has them.

    In the whole table a user has more chunks than in the sample, and nearer ones, so this errs to the safe side.
    """
    if not len(centers):
        return 1
    cells, ranks = nearest_of(points, centers), []
    for q in range(min(asked, len(points))):
        own = np.flatnonzero(users == users[q])
        own = own[own != q]
        if len(own):
            near = own[np.argsort(-(points[own] @ points[q]))[: max(1, min(MAX_CANDIDATES, len(own) // 2))]]
            place = np.empty(len(centers), np.int64)
            place[np.argsort(-(centers @ points[q]), kind="stable")] = np.arange(len(centers))
            ranks += place[cells[near]].tolist()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else len(centers)


def write_index(chunks: DataFrame, path: str, dim: int, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rows_per_file: int = ROWS_PER_FILE, recall: float = RECALL) -> None:
    """Store the chunks (``COLUMNS``) with vectors of ``dim`` numbers under ``path``; about the root of their number as ``cells`` where none is given. Vectors of length zero, no candidates of any search, lie in cell -1."""
    spark = chunks.sparkSession
    usable = chunks.where(F.size("embedding") == dim).select(*COLUMNS)
    cells = cells or max(1, int(usable.count() ** 0.5))
    users, points = sampled(usable, dim, sample_rows)
    centers = fit_centroids(points, cells)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame([(probes_needed(users, points, centers, recall),)], "probes int").write.mode("overwrite").parquet(f"{path}/settings")
    spark.createDataFrame(rows, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            points = unit(np.array(vectors.tolist(), np.float64).reshape(-1, dim))
            zero = np.isnan(points).any(axis=1)
            found = nearest_of(np.nan_to_num(points), shared.value) if len(shared.value) else np.full(len(points), -1)
            yield pd.Series(np.where(zero, -1, found), index=vectors.index, dtype="int32")

    dealt = F.pmod(F.xxhash64("chunk_id", "source", "chunk_index"), F.lit(1 << 20))
    placed = usable.withColumn("cell", nearest("embedding"))
    placed.repartition("cell", F.floor(dealt * F.lit(max(1, -(-usable.count() // rows_per_file))) / (1 << 20))).sortWithinPartitions("cell", "user_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows], np.float64)


def search_index(spark: SparkSession, path: str, queries: DataFrame, probes: int | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, user_id, source, chunk_index, chunk_id, similarity, rank): up to ``MAX_CANDIDATES`` chunks of each question's user in the ``probes`` partitions nearest to it.

    With all partitions as probes the result is exact, and without a number as many are read as the index says. The index is searched for
    ``SHARED_QUESTIONS`` questions at a time: what a task holds does not grow with their number.
    """
    centers = centroids(spark, path)
    probes = probes or spark.read.parquet(f"{path}/settings").first()["probes"]
    asked = queries.select(F.col("query_id").cast("bigint"), F.col("user_id").cast("int"), "embedding").where("embedding IS NOT NULL AND user_id IS NOT NULL")
    stored = spark.read.schema(STORED).parquet(f"{path}/chunks")
    found = stored.where(F.lit(False)).mapInArrow(searching(spark, {}, skip_self), FOUND)
    rows = asked.toLocalIterator()
    while block := list(islice(rows, SHARED_QUESTIONS)):
        wanted = probed(block, centers, probes)
        if wanted:
            cells = np.flatnonzero(np.any([met.any(axis=1) for _, _, met in wanted.values()], axis=0)).tolist()
            found = found.unionByName(stored.where(F.col("cell").isin(cells) & F.col("user_id").isin(sorted(wanted))).mapInArrow(searching(spark, wanted, skip_self), FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source", "chunk_index", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CANDIDATES)


def probed(block: list[tuple], centers: np.ndarray, probes: int) -> dict[int, tuple[np.ndarray, list, np.ndarray]]:
    """By user: the unit vectors of the questions, their ids, and for each cell which of them look into it. Each vector is there once, however many probes it has."""
    by_user: dict[int, tuple[list, list]] = {}
    for query_id, user, vector in block:
        point = np.array(vector, np.float64)
        if len(centers) and len(point) == centers.shape[1] and point.any():
            points, names = by_user.setdefault(user, ([], []))
            points.append(point)
            names.append(query_id)
    wanted = {}
    for user, (points, names) in by_user.items():
        matrix, met = unit(np.array(points)), np.zeros((len(centers), len(points)), bool)
        for q, point in enumerate(points):
            met[np.argsort(-(centers @ point), kind="stable")[:probes], q] = True
        wanted[user] = (matrix, names, met)
    return wanted


def searching(spark: SparkSession, wanted: dict, skip_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The search of a task in its part of the index for the questions ``wanted`` (as ``probed`` gives them)."""
    shared = spark.sparkContext.broadcast(wanted)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for batch in batches:
            flat, starts, sizes = vectors_of(batch)
            users, ids, cells = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("user_id", "chunk_id", "cell"))
            for cell, user in sorted({(int(c), int(u)) for c, u in zip(cells, users, strict=True) if u in shared.value and c >= 0}):
                points, names, met = shared.value[user]
                asking = np.flatnonzero(met[cell])
                if len(asking):
                    at = np.flatnonzero((cells == cell) & (users == user))
                    score_block(best, flat[starts[at][:, None] + np.arange(sizes[at[0]])], at, ids[at], points[asking], [names[q] for q in asking], described(batch), skip_self)
        yield best.batch()

    return search


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(n_questions, n_exact, recall): the share of the exact candidates that were found."""
    met = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("n_questions"), F.count(F.lit(1)).alias("n_exact"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
