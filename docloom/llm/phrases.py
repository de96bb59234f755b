"""Phrase collocation mining by relations (SETM).

The occurrence relation of length k is a persisted table whose rows are blocks of ``BLOCK`` word positions: sorted lists of the position
behind each phrase (as gaps) and of the phrase's words, beside the frequent words of the block with their positions. Pieces are
apart by a position without a word, so equal positions mean the same piece. A relation is extended by a merge join of its positions with those of the
words, counted by group, and the groups with fewer than ``least`` occurrences leave it by a semi-join before it is persisted and
extended again: no phrase is more frequent than a part of it. Numpy joins the sorted lists inside tasks; Spark
counts the groups, holds the relations and joins what is counted.

A block ends wherever its positions are used up, in the middle of a piece if need be, and begins with what the one before looks ahead to: its last
phrases reach ``most_words`` - 1 positions further, and a phrase counts where its first word is the block's own. So blocks are of one size
whatever the texts are, and no list grows with a text, a piece or a phrase.

Words are numbers per language, so counts are per language. A number comes from the hash of (language, word) under the first seed that gives no
frequent word the hash of another word (the texts are read again where one does): exact. Frequent words and phrases up to ``BROADCAST_ROWS`` are sent to the tasks; more
than that meet the occurrences in shuffled joins (``regrouped``), which give the same relation.

A candidate's score is the least, over its cuts in two, of floor(1000000 a a / (l r)) in decimals of 38 digits, which hold counts
up to 10^15. A candidate goes if a longer one that contains it is at least half as frequent. The first ``top`` of each language
are ranked in two steps, so that no task sorts all candidates of a language.

Defined cases: null text has no pieces; null and 'und' are one language; A-Z are lower-cased, other letters stay as they are; rows that repeat
count each time; ids are not looked at; ties go by count, then by the bytes of the phrase; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise
from docloom.sources.scratch import settings

LEAST, MOST_WORDS, TOP, SHARE = 10, 3, 2000, 50
#: Positions of a block, and blocks (or texts) of an Arrow batch.
BLOCK, BATCH_ROWS = 1 << 14, 32
#: Rows of frequent words or phrases that are sent to every task (some numbers each, so under 100 MB).
BROADCAST_ROWS = 2_000_000
#: Different words that a task knows before it writes their counts and starts anew.
KNOWN_WORDS = 300_000
SALTS = 64
#: Fixed by the contract: A-Z in lower case, the marks between pieces, the blanks between words.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
BREAK, NOTHING = b"\n", b""
#: Numbers of words repeat, so a large dictionary shrinks them.
STORED = {"parquet.dictionary.page.size": str(16 << 20), "compression": "zstd"}
#: Words are new in almost every row of the table that the texts become: a dictionary of them would only take memory.
PLAIN_WORDS = {"parquet.enable.dictionary#word": "false"}


def tokens(text: str) -> list[bytes]:
    """The words of ``text``, with ``BREAK`` between pieces and ``NOTHING`` here and there."""
    return text.encode("utf-8", "surrogatepass").translate(CLEAN).replace(b"\n", b" \n ").split(b" ")


def ids(k: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + k)]


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")


def hash_of(seed: int) -> Column:
    return F.xxhash64(F.concat_ws("\n", F.lit(str(seed)), "lang", "word"))


def hashes(seed: int, lang: str, words: list[bytes]) -> np.ndarray:
    """As ``hash_of``."""
    head = f"{seed}\n{lang}\n".encode("utf-8", "surrogatepass")
    return np.array([xxhash.xxh64_intdigest(head + word, 42) for word in words], np.uint64).view(np.int64)


def exact(words: DataFrame, seed: int, least: int) -> bool:
    """Whether every frequent word has a hash of its own."""
    shared = words.groupBy(hash_of(seed).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most"))
    return shared.where((F.col("most") >= least) & ((F.col("n") > 1) | (F.col("hash") == 0))).isEmpty()


def arrays(rows: DataFrame, columns: list[str], limit: int) -> list[np.ndarray] | None:
    """``columns`` of ``rows`` on the driver, if there are at most ``limit`` rows."""
    some = rows.select(*columns).limit(limit + 1).toArrow()
    return None if some.num_rows > limit else [some.column(c).to_numpy() for c in columns]


# ---- the relations


def narrow(relation: DataFrame):
    """Blocks are read as many at a time as go to a task's Python: Spark would hold 4,096 at once, whose lists are hundreds of MB for each task."""
    return settings(relation.sparkSession, spark__sql__parquet__columnarReaderBatchSize=str(BATCH_ROWS))


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and the sizes of the lists."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def positions(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Sorted positions of a batch from the gaps of each block: the block in the upper half."""
    gaps, sizes = flat(batch, name)
    total = np.cumsum(gaps, dtype=np.int64)
    before = np.concatenate(([0], total))[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes) + (np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32)


def gaps_of(places: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The gaps of sorted positions, and the number of them in each block."""
    block, place = places >> 32, places & 0xFFFFFFFF
    first = np.diff(block, prepend=-1) != 0
    return np.where(first, place, np.diff(place, prepend=0)), np.bincount(block, minlength=blocks)


class Vocabulary(dict):
    """Places of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Known:
    """The words that a task has met: their places by language, their hashes and counts by place."""

    def __init__(self, seed: int):
        self.seed, self.places, self.hashes, self.counts = seed, {}, {}, {}

    def __len__(self) -> int:
        return sum(map(len, self.places.values()))

    def number(self, langs: list[str], texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the hashes of its words; 0 for ``BREAK``, and nothing for ``NOTHING``. Counts and hashes are brought up to date once for all texts."""
        found = []
        for lang, text in zip(langs, texts, strict=True):
            places = self.places.setdefault(lang, Vocabulary({BREAK: 0, NOTHING: 1}))
            words = tokens(text)
            at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
            found.append(at[at != 1])
        for lang in dict.fromkeys(langs):
            places, own = self.places[lang], self.hashes.get(lang, np.zeros(2, np.int64))
            new = list(islice(reversed(places), len(places) - len(own)))[::-1]
            self.hashes[lang] = np.concatenate((own, hashes(self.seed, lang, new)))
            counts = np.bincount(np.concatenate([at for at, of in zip(found, langs, strict=True) if of == lang]), minlength=len(places))
            old = self.counts.get(lang, counts[:0])
            counts[: len(old)] += old
            self.counts[lang] = counts
        for lang, at in zip(langs, found, strict=True):
            yield self.hashes[lang][at]

    def vocabulary(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Languages, words and counts."""
        rows = [(lang, list(places)[2:], self.counts[lang][2:]) for lang, places in self.places.items() if len(places) > 2]
        words = pa.array([w for _, part, _ in rows for w in part], pa.binary()).cast(pa.string())
        langs = pa.array([lang for lang, part, _ in rows for _ in part], pa.string())
        return langs, words, pa.array(np.concatenate([n for _, _, n in rows]) if rows else [], pa.int64())


def word_relation(texts: DataFrame, seed: int, longest: int, size: int = BLOCK) -> DataFrame:
    """Blocks (gaps, words), the positions (from 1) and hashes of all words, and rows (lang, word, n) of what a task has counted, in one table: texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(seed)

        def rows(gaps: pa.Array, words: pa.Array, lang: pa.Array, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([gaps, words, lang, word, n], names=["gaps", "words", "lang", "word", "n"])

        def counted() -> pa.RecordBatch:
            lang, word, n = known.vocabulary()
            return rows(pa.nulls(len(n), pa.list_(pa.int32())), pa.nulls(len(n), pa.list_(pa.int64())), lang, word, n)

        for batch in batches:
            parts, words = [], [np.empty(0, np.int64)]
            for found in known.number(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words += [found, np.zeros(1, np.int64)]
            stream = np.concatenate(words)
            for k in range(0, len(stream), size):
                block = stream[k : k + size + longest - 1]
                at = np.flatnonzero(block)
                parts.append((np.diff(at, prepend=-1), block[at]))
            if parts:
                sizes, none = [len(w) for _, w in parts], [pa.nulls(len(parts), kind) for kind in (pa.string(), pa.string(), pa.int64())]
                yield rows(lists(np.concatenate([g for g, _ in parts]), sizes, pa.int32()), lists(np.concatenate([w for _, w in parts]), sizes, pa.int64()), *none)
            if len(known) > KNOWN_WORDS:
                yield counted()
                known = Known(seed)
        yield counted()

    return materialise(texts.mapInArrow(run, "gaps array<int>, words array<bigint>, lang string, word string, n bigint"), "phrase-words-at", **STORED, **PLAIN_WORDS)


class Frequent:
    """The frequent words as they are sent to the tasks: which hash is which number."""

    def __init__(self, hash: np.ndarray, id: np.ndarray):
        order = np.argsort(hash)
        self.hash, self.id = hash[order], id[order]

    def of(self, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The semi-join: positions and numbers of the words that are frequent."""
        if not len(self.hash) or not len(words):
            return at[:0], words[:0]
        values, inverse = np.unique(words, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, values), len(self.hash) - 1)
        number = np.where(self.hash[place] == values, self.id[place], -1)[inverse]
        held = number >= 0
        return at[held], number[held]


def regrouped(relation: DataFrame, columns: list[str], groups: DataFrame, gaps: str, renamed: str | None = None) -> DataFrame:
    """The relation (with ``block``) of the occurrences whose ``columns`` are in ``groups``, by shuffled joins instead of what is sent to the tasks.

    A block's lists are of bounded size; hot groups are split by the join.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes = flat(batch, gaps)
            block = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            parts = [block, positions(batch, gaps) & 0xFFFFFFFF, *[flat(batch, c)[0] for c in columns]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["block", "place", *columns])

    rows = relation.select("block", gaps, *columns).mapInArrow(single, ", ".join(f"{c} bigint" for c in ["block", "place", *columns]))
    with narrow(relation):
        occurrences = materialise(rows, "phrase-occurrences", **STORED)
    met = occurrences.join(groups.hint("merge"), columns, "inner" if renamed else "left_semi")
    values = [F.col(renamed).alias(columns[0])] if renamed else [F.col(c) for c in columns]
    sorted_rows = F.array_sort(F.collect_list(F.struct("place", *values)))
    blocks = met.groupBy("block").agg(sorted_rows.alias("rows"))
    new_gaps = F.transform("rows", lambda r, i: (r["place"] - F.coalesce(F.get(F.col("rows"), i - 1)["place"], F.lit(0))).cast("int")).alias(gaps)
    found = blocks.select("block", new_gaps, *[F.col(f"rows.{c}").alias(c) for c in columns])
    rest = [c for c in relation.columns if c not in ("block", gaps, *columns)]
    kept = found.join(relation.select("block", *rest), "block").drop("block") if rest else found.drop("block")
    with narrow(relation):
        return materialise(kept.select(*[c for c in relation.columns if c != "block"]), "phrase-regrouped", **STORED)


def words_at(batch: pa.RecordBatch, frequent: Frequent | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers of the frequent words of a batch; ``frequent`` where the batch has hashes of all words."""
    at, (words, _) = positions(batch, "gaps"), flat(batch, "words")
    return (at, words) if frequent is None else frequent.of(at, words)


def extended(batch: pa.RecordBatch, k: int, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The positions behind the phrases of ``k`` words and their words: the phrases of k-1 words meet the word at their next position."""
    next, columns = (at + 1, [words]) if k == 2 else (positions(batch, "next_gaps"), [flat(batch, c)[0] for c in ids(k - 1)])
    place = np.searchsorted(at, next)
    met = np.flatnonzero(np.append(at, -1)[place] == next)
    return next[met] + 1, [c[met] for c in columns] + [words[place[met]]]


def groups_of(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns``, and the count of each."""
    factors = [np.unique(c, return_inverse=True) for c in columns]
    codes, width = np.zeros(len(columns[0]), np.int64), 1
    for values, inverse in factors:
        if width * len(values) >= 1 << 62:
            joint, codes = np.unique(codes, return_inverse=True)
            width = len(joint)
        codes = codes * len(values) + inverse
        width *= len(values)
    _, first, counts = np.unique(codes, return_index=True, return_counts=True) if len(columns) > 3 else (None, *firsts(codes))
    return [c[first] for c in columns], counts


def firsts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each code."""
    order = np.argsort(codes)
    starts = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1)) if len(codes) else np.empty(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(codes)))


def count_phrases(relation: DataFrame, k: int, least: int, size: int = BLOCK, known: Frequent | None = None) -> DataFrame:
    """(w1..wk, a) of the phrases of ``k`` words with at least ``least`` occurrences."""
    shared = relation.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            next, columns = extended(batch, k, *words_at(batch, shared.value))
            own = (next & 0xFFFFFFFF) - k <= size
            if own.any():
                distinct, counts = groups_of([c[own] for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in [*distinct, counts]], names=[*ids(k), "n"])

    made = relation.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*ids(k), "n"]))
    with narrow(relation):
        return materialise(made.groupBy(*ids(k)).agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"phrases-{k}")


class Members:
    """Rows of numbers, for look-ups of many rows at once."""

    def __init__(self, columns: list[np.ndarray]):
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        codes = np.zeros(len(columns[0]), np.int64)
        for column in columns:
            values, inverse = np.unique(column, return_inverse=True)
            joint, codes = np.unique(codes * len(values) + inverse, return_inverse=True)
            self.steps.append((values, joint))

    def held(self, columns: list[np.ndarray]) -> np.ndarray:
        codes, ok = np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]), bool)
        for column, (values, joint) in zip(columns, self.steps, strict=True):
            if not len(values):
                return np.zeros(len(codes), bool)
            at = np.minimum(np.searchsorted(values, column), len(values) - 1)
            ok &= values[at] == column
            wanted = codes * len(values) + at
            codes = np.minimum(np.searchsorted(joint, wanted), len(joint) - 1)
            ok &= joint[codes] == wanted
        return ok


def phrase_relation(relation: DataFrame, k: int, frequent: DataFrame, limit: int, known: Frequent | None = None) -> DataFrame:
    """(gaps, words, next_gaps, w1..wk): the frequent phrases of ``k`` words of each block, beside its words."""
    sent = arrays(frequent, ids(k), limit)
    shared = relation.sparkSession.sparkContext.broadcast((sent, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, words_known = shared.value
        members = None if groups is None else Members(groups)
        for batch in batches:
            at, words = words_at(batch, words_known)
            next, columns = extended(batch, k, at, words)
            if members is not None:
                held = members.held(columns)
                next, columns = next[held], [c[held] for c in columns]
            gaps, sizes = gaps_of(next, batch.num_rows)
            own, own_sizes = gaps_of(at, batch.num_rows)
            stored = [lists(own, own_sizes, pa.int32()), lists(words, own_sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*stored, lists(gaps, sizes, pa.int32()), *[lists(c, sizes, pa.int64()) for c in columns]], names=["gaps", "words", "next_gaps", *ids(k)])

    made = relation.mapInArrow(run, "gaps array<int>, words array<bigint>, next_gaps array<int>, " + ", ".join(f"{c} array<bigint>" for c in ids(k)))
    with narrow(relation):
        if sent is not None:
            return materialise(made, f"phrases-at-{k}", **STORED)
        numbered = materialise(made.select(F.monotonically_increasing_id().alias("block"), "*"), "phrase-blocks", **STORED)
    return regrouped(numbered, ids(k), frequent.select(*ids(k)), "next_gaps")


# ---- what is counted


def scored(counts: dict[int, DataFrame], k: int) -> DataFrame:
    """(w1..wk, a, l, r, score) of the phrases of ``k`` words: the cut of the least score, of equal ones the first."""
    rows = counts[k]
    cuts = []
    for cut in range(1, k):
        left = counts[cut].select(*ids(cut), F.col("a").alias(f"l{cut}"))
        right = counts[k - cut].select(*[F.col(f"w{i}").alias(f"w{i + cut}") for i in range(1, k - cut + 1)], F.col("a").alias(f"r{cut}"))
        rows = rows.join(left, ids(cut)).join(right, ids(k - cut, cut + 1))
        cuts.append(F.struct(floored(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    best = rows.select(*ids(k), "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("best"))
    return best.select(*ids(k), "a", "best.l", "best.r", "best.score")


def floored(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers."""
    a, l, r = (c.cast("decimal(18,0)") for c in (a, l, r))
    product = (a * a * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, (l * r).cast("decimal(38,0)")).cast("bigint")


def uncovered(candidates: dict[int, DataFrame], k: int, share: int) -> DataFrame:
    """The candidates of ``k`` words that no longer one contains with ``share`` percent of their occurrences."""
    parts = [longer.select(*[F.col(f"w{i + at}").alias(f"w{i}") for i in range(1, k + 1)], F.col("a").alias("most")) for m, longer in candidates.items() if m > k for at in range(m - k + 1)]
    if not parts:
        return candidates[k]
    held = reduce(DataFrame.unionByName, parts).groupBy(*ids(k)).agg(F.max("most").alias("most"))
    return candidates[k].join(held, ids(k), "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")


def with_words(rows: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, a, l, r, score)."""
    for i in range(1, k + 1):
        rows = rows.join(frequent.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 1 else [])), f"w{i}")
    return rows.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(1, k + 1)]).alias("phrase"), "a", "l", "r", "score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("salt")


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS, block: int = BLOCK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``most_words`` words of each language."""
    texts = texts_of(docs, text, lang)
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        for seed in range(1, 100):
            read = word_relation(texts, seed, most_words, block)
            words = materialise(read.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
            if exact(words, seed, least):
                break
            discard(read, words)
        # An id is fixed when the table is written, as each partition is committed once.
        frequent = materialise(words.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f", hash_of(seed).alias("hash")), "phrase-frequent")
        counts = {1: frequent.select(F.col("id").alias("w1"), F.col("f").alias("a"))}
        sent = arrays(frequent, ["hash", "id"], broadcast_rows)
        known, relation = None if sent is None else Frequent(*sent), read.where("word IS NULL").select("gaps", "words")
        if sent is None:
            with narrow(relation):
                numbered = materialise(relation.select(F.monotonically_increasing_id().alias("block"), "gaps", "words"), "phrase-blocks", **STORED)
            relation = regrouped(numbered, ["words"], frequent.select(F.col("hash").alias("words"), F.col("id").alias("to")), "gaps", "to")
        for k in range(2, most_words + 1):
            counts[k] = count_phrases(relation, k, least, block, known)
            if k < most_words:
                relation, known = phrase_relation(relation, k, counts[k], broadcast_rows, known), None
            if k == 2:
                discard(read)
    found = {k: scored(counts, k) for k in range(2, most_words + 1)}
    named = [with_words(uncovered(found, k, share), frequent, k) for k in found]
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(materialise(reduce(DataFrame.unionByName, named), "phrases"), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first 2,000 phrases of each language."""
    return mine_phrases(docs)


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS r, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS a FROM p),
o AS (SELECT r, lang, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w),
t AS (SELECT lang, word AS w1, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM o WINDOW s AS (PARTITION BY r ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT c.lang, c.w1, c.w2, c.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
       FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10),
s3 AS (SELECT c.*, x1.f AS l1, y1.f AS r1, 1000000::HUGEINT * c.f * c.f // (x1.f::HUGEINT * y1.f) AS s1, x2.f AS l2, y2.f AS r2, 1000000::HUGEINT * c.f * c.f // (x2.f::HUGEINT * y2.f) AS s2
       FROM f3 c JOIN f1 x1 ON x1.lang = c.lang AND x1.w1 = c.w1 JOIN f2 y1 ON y1.lang = c.lang AND y1.w1 = c.w2 AND y1.w2 = c.w3
       JOIN f2 x2 ON x2.lang = c.lang AND x2.w1 = c.w1 AND x2.w2 = c.w2 JOIN f1 y2 ON y2.lang = c.lang AND y2.w1 = c.w3),
c3 AS (SELECT lang, w1, w2, w3, f AS a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM s3),
held AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL),
c AS (SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, a, l, r, score FROM c2 LEFT JOIN held h ON h.lang = c2.lang AND h.w1 = c2.w1 AND h.w2 = c2.w2 WHERE most IS NULL OR 100 * most < 50 * a
      UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, l, r, score FROM c3),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score::BIGINT AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
