"""Jaccard self-join of documents on word n-grams, by chosen paths.

A set of n-grams is split recursively on sampled tokens: at each level a run samples, by its own hash
function, one token of a set, and sets that sampled the same tokens so far share a bucket. Buckets of at
most ``bucket`` sets are compared by brute force, larger ones are split once more; what is still large
after ``DEPTH`` levels is compared block against block. Two sets of similarity J share a bucket of depth d
with probability J**d, so ``runs_for`` gives the runs that reach the target recall at the threshold.

Comparison has two steps. Inside buckets, 128-byte sketches (least token of each of 128 hash ranges)
discard pairs that are far below the threshold and the rest is linked by spanning edges, at most one per set and
bucket. The sets of one component of these edges then meet once, and their exact similarities are counted,
so that every pair of a component is decided exactly however many runs found it.

Hot groups: equal sets are one set with a count. Large buckets and components are dealt into blocks of
about ``BLOCK`` sets, and pairs of blocks are tasks of bounded size; pairs are counted where they are
compared and never emitted. What travels to the blocks is the hashes of a set, written once, not its text.

Defined cases: words are runs of non-blanks of the text in lower case; a text of fewer than n words has one
n-gram, all its words; null and wordless texts are linked to nothing, each a class of its own; repeated rows
are copies; a null id never becomes a class id unless all ids of the class are null; other columns are not
read by the join and are kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import discard, free_name, materialise
from docloom.llm.components import components

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
DEPTH, BUCKET, BLOCK, BINS = 3, 128, 256, 128
#: A pair at the threshold has a sketch estimate further below it than this in less than one of a thousand cases, as the tests measure by set size.
SKETCH_MARGIN = 0.17
CACHED_WORDS = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)
PATHS = pa.list_(pa.struct([("p2", pa.int64()), ("p3", pa.int64())]))


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


class Shingler:
    """Sets of n-gram hashes of texts, with hashes of frequent words kept."""

    def __init__(self, n: int = NGRAM):
        self.n, self.words = n, {}

    def word(self, word: str) -> int:
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63
        self.words[word] = found
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes; empty for a text without words."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words.get
        hashes = np.fromiter((v if (v := known(w)) is not None else self.word(w) for w in words), np.int64, len(words)).view(np.uint64)
        k = min(self.n, len(hashes))
        count = len(hashes) - k + 1
        out = np.zeros(count, np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : i + count]) * ODD
            out ^= out >> np.uint64(31)
        return np.unique(out)


def least_hashes(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each hash function the least hash of the set: the token that it samples."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 8192):
        mixed = tokens[i : i + 8192, None] * factors[None, :]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(out, (mixed * ODD).min(axis=0), out=out)
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """For each of ``BINS`` ranges of the sorted hashes a byte of the least one in it; 0 where there is none."""
    shift = np.uint64(64 - int(math.log2(BINS)))
    at = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << shift)
    first = tokens[np.minimum(at, len(tokens) - 1)]
    there = (at < len(tokens)) & (first >> shift == np.arange(BINS, dtype=np.uint64))
    return np.where(there, 1 + (first * ODD >> np.uint64(40)) % np.uint64(255), 0).astype(np.uint8).tobytes()


def set_rows(n: int, runs: int):
    """For Arrow batches of id, row and text: the digest, the sketch and the paths of each text's set."""
    factors = np.random.default_rng(20).integers(1, 2**63, runs * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = np.arange(runs, dtype=np.uint64) * ODD

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            digests, sketches, paths = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingler.shingles(text)
                if not len(tokens):
                    digests.append(None)
                    sketches.append(None)
                    paths.append(None)
                    continue
                least = least_hashes(tokens, factors).reshape(runs, DEPTH)
                p2 = ((least[:, 0] ^ salts) * ODD ^ least[:, 1]) * ODD
                p3 = (p2 ^ (p2 >> np.uint64(29)) ^ least[:, 2]) * ODD
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                sketches.append(sketch(tokens))
                paths.append([{"p2": a, "p3": b} for a, b in zip(p2.view(np.int64).tolist(), p3.view(np.int64).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, PATHS)], names=["id", "row", "digest", "sketch", "paths"])

    return rows


def sized(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key others share, with the number ``n`` of rows of the key; and the table of these numbers.

    The counts are written first: a join right above an aggregate on the same key would keep a hot key in one task.
    """
    sizes = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    return rows.join(sizes, key), sizes


def block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that it takes part in: (key, i, j), i <= j, and its ``side``."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.withColumn("_own", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.struct(F.col(key).alias("key"), F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    return other.select(pair.alias("pair"), (F.col("_own") == F.least("_own", "_other")).alias("side"), *[c for c in rows.columns if c not in (key, "n")])


def per_pair(rows: DataFrame, compare, columns: list[str], schema: str) -> DataFrame:
    """Bring the rows of each pair of blocks together and hand them to ``compare`` as Arrow batches."""
    dealt = rows.withColumn("pair_id", F.concat(F.hex("pair.key"), F.lpad(F.col("pair.i").cast("string"), 8, "0"), F.lpad(F.col("pair.j").cast("string"), 8, "0")))
    return dealt.select("pair_id", (F.col("pair.i") == F.col("pair.j")).alias("alone"), "side", *columns).repartition("pair_id").sortWithinPartitions("pair_id").mapInArrow(groups_of(compare), schema)


def groups_of(compare):
    """Cut sorted batches into groups of one pair_id and yield what ``compare`` makes of them, in large batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("pair_id").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if held and held[-1].column("pair_id")[0].as_py() != ids[0]:
                yield from done(held)
                held = []
            if len(cuts):
                head, last = batch.slice(0, cuts[-1]), batch.slice(cuts[-1])
                yield from done([*held, head])
                held = [last]
            else:
                held.append(batch)
        if held:
            yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if not table.num_rows:
            return
        ids = table.column("pair_id").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        batch = table.to_batches()[0]
        out = compare(batch, [(int(a), int(b)) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1])
        if out is not None and out.num_rows:
            yield out

    return run


def roots(linked: np.ndarray, names: list[bytes]) -> list[bytes]:
    """For each row of a symmetric boolean matrix the least name of its component."""
    label = np.array(sorted(range(len(names)), key=names.__getitem__)).argsort()
    order = label.copy()
    while True:
        least = np.where(linked, label[None, :], len(names)).min(axis=1)
        new = np.minimum(label, least)
        if (new == label).all():
            break
        label = new
    by_rank = {int(r): n for r, n in zip(order, names, strict=True)}
    return [by_rank[int(r)] for r in label]


def sketch_edges(minimum: float):
    def compare(batch: pa.RecordBatch, groups: list[tuple[int, int]]) -> pa.RecordBatch | None:
        names = batch.column("digest").to_pylist()
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        sides, alone = batch.column("side").to_numpy(zero_copy_only=False), batch.column("alone").to_numpy(zero_copy_only=False)
        left, right = [], []
        for a, b in groups:
            part, name = sketches[a:b], names[a:b]
            if b - a == 2:
                x, y = part
                if (alone[a] or sides[a] != sides[a + 1]) and ((x == y) & (x > 0)).sum() >= minimum * ((x > 0) | (y > 0)).sum():
                    left.append(max(name))
                    right.append(min(name))
                continue
            linked = np.zeros((b - a, b - a), bool)
            there = part > 0
            for k in range(b - a):
                hit = ((part == part[k]) & there).sum(axis=1)
                linked[k] = hit >= minimum * (there | there[k]).sum(axis=1)
            if not alone[a]:
                side = sides[a:b]
                linked &= side[:, None] != side[None, :]
            for n, r in zip(name, roots(linked | linked.T, name), strict=True):
                if n != r:
                    left.append(n)
                    right.append(r)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return compare


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        chunk = np.zeros((len(sets), 4096), np.float32)
        chunk[owner[i:j], column[i:j] - at] = 1
        out += chunk @ chunk.T
    return out


def token_rows(n: int):
    """For Arrow batches of root, n, digest, copies and text: the text replaced by the hashes of its set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            tokens = pa.array([shingler.shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "n", "digest", "copies")), tokens], names=["root", "n", "digest", "copies", "tokens"])

    return rows


def exact_links(threshold: float):
    def compare(batch: pa.RecordBatch, groups: list[tuple[int, int]]) -> pa.RecordBatch | None:
        names, tokens, copies = (batch.column(c).to_pylist() for c in ("digest", "tokens", "copies"))
        sides, alone = batch.column("side").to_numpy(zero_copy_only=False), batch.column("alone").to_numpy(zero_copy_only=False)
        digests, links, root = [], [], []
        for a, b in groups:
            at = list({names[k]: k for k in range(a, b)}.values())  # a set comes twice if its row is repeated
            name, sets = [names[k] for k in at], [np.frombuffer(tokens[k], np.uint64) for k in at]
            if len(sets) < 2:
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if not alone[a]:
                side = sides[at]
                linked &= side[:, None] != side[None, :]
            digests += name
            links += (linked * np.array([copies[k] for k in at])[None, :]).sum(axis=1).tolist()
            root += roots(linked, name)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())], names=["digest", "links", "root"])

    return compare


def jaccard_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, row, class_id, n_links, keeper) of every row; ``row`` is the hash of its text.

    ``class_id`` is the least id of the connected class, ``n_links`` the number of other rows of similarity
    ``threshold`` or more, ``keeper`` whether the row is the one of its class to stay.
    """
    runs = runs_for(recall, threshold)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    path = T.StructType([T.StructField("p2", T.LongType()), T.StructField("p3", T.LongType())])
    added = {"row": T.LongType(), "digest": T.BinaryType(), "sketch": T.BinaryType(), "paths": T.ArrayType(path)}
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(k, v) for k, v in added.items()]])
    rows = materialise(source.mapInArrow(set_rows(n, runs), schema), "sets")

    first = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))), F.min(F.struct("id", "row")))
    sets = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), first.alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("paths").alias("paths"))
    sets = materialise(sets, "distinct-sets")

    narrow = sets.select("digest", F.inline("paths"))
    level2, sizes2 = sized(narrow, "p2")
    level3, sizes3 = sized(level2.where(F.col("n") > BUCKET).drop("n"), "p3")
    buckets = level2.where(F.col("n") <= BUCKET).select(F.col("p2").alias("path"), "n", "digest").unionByName(level3.select(F.col("p3").alias("path"), "n", "digest"))
    sketched = block_pairs(buckets.join(sets.select("digest", "sketch"), "digest"), "path")
    edges = per_pair(sketched, sketch_edges(max(0.05, threshold - SKETCH_MARGIN)), ["digest", "sketch"], "a binary, b binary").distinct()
    groups = components(edges)

    grouped, sizes = sized(groups.select(F.col("node").alias("digest"), "root"), "root")
    members = grouped.join(sets.select("digest", "copies", "first"), "digest")
    with_text = members.join(source, F.col("first.id").eqNullSafe(source["id"]) & (F.col("first.row") == source["row"])).select("root", "n", "digest", "copies", "text")
    with_tokens = materialise(with_text.mapInArrow(token_rows(n), "root binary, n bigint, digest binary, copies bigint, tokens binary"), "member-sets")
    discard(sizes2, sizes3, sizes)
    checked = materialise(per_pair(block_pairs(with_tokens, "root"), exact_links(threshold), ["digest", "tokens", "copies"], "digest binary, links bigint, root binary"), "links")
    discard(with_tokens)
    labels = components(checked.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    linked = checked.groupBy("digest").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("node", "digest"), "digest", "left")

    classed = sets.select("digest", "copies", "first").join(linked, "digest", "left").select("digest", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "digest").alias("root"))
    known = "CASE WHEN first.id IS NOT NULL THEN first END"
    heads = materialise(classed.groupBy("root").agg(F.coalesce(F.min(F.expr(known)), F.min("first")).alias("head")), "heads")
    final = materialise(classed.join(heads, "root").select("digest", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "head"), "classes")
    discard(sets, checked, heads, groups, labels)
    out = rows.select("id", "row", "digest").join(final, "digest", "left")
    keeper = F.col("digest").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("row") == F.col("head.row")))
    return out.select("id", "row", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), keeper.alias("keeper"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each class of near copies, and the rows without words; rows that repeat id and text stay once."""
    classes = materialise(jaccard_classes(docs, text, id_col), "classes")
    gone = classes.where(~F.col("keeper")).select("id", "row").distinct()
    same = docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text]) == gone["row"])
    kept = docs.join(gone, same, "left_anti")
    if classes.groupBy("id", "row").count().where("count > 1").isEmpty():
        return kept
    hashed = free_name(docs, "text_hash")
    return kept.withColumn(hashed, F.xxhash64(text)).dropDuplicates([id_col, hashed]).drop(hashed)


def op2_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``documents``."""
    return jaccard_classes(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "n_links")
