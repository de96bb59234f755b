"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts and lexicon are folded alike: lower case, look-alike letters of other scripts to Latin ones, digits and
signs that stand for letters inside words, letters stretched to three or more shortened, invisible characters
removed. The automaton holds the lexicon and exception phrases; a term counts where it stands as a whole
word and outside an exception. The weights found, as they are and per hundred words, are turned into a score
by a logistic function.

Everything is learned from a bounded, documented sample of labelled rows: the ``toxic_rows`` toxic and
``clean_rows`` other documents whose id hashes lowest. The lexicon is the words that documents of label 1 hold more often, weighed by log odds.
Exception phrases are given ones and those learned: two words, one of them a term, that documents of label 0 hold more often. The
logistic function is fitted on weights that each half of the sample finds with the lexicon and exceptions of the other.

Defined cases: null and empty texts score what a text without any term scores, below 0.5 unless most labels
are 1; without labels of both kinds nothing is learned and every score is 0; documents without a label are
only scored; repeated label rows count as often as they come; null ids are neither trained on nor held out; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, id_bucket, materialise

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s",
}
#: Digits and signs written for letters.
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = re.compile("[­​-‏⁠﻿]")
STANDIN = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<!\w)[@$](?=[^\W\d_])|(?<!\w)[013457]+(?=[^\W\d_][^\W_])|(?<=[^\W\d_]{2})[013457@$]+(?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
TABLE = str.maketrans(LOOKALIKES)
STANDIN_TABLE = str.maketrans(STANDINS)
WORD = re.compile(r"[^\W_]+")
#: Phrases in which a term is harmless, beside those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "worthless check")
#: A phrase of two words, one of them a term, is learned as an exception if so many sampled documents of label 0 hold it, and it speaks for label 0 by this log odds.
EXCEPTION_DOCS, EXCEPTION_ODDS = 4, 1.0
#: The word before a term and the one after it, one blank away.
BEFORE, AFTER = re.compile(r"[^\W_]+ \Z"), re.compile(r" [^\W_]+")
#: Terms and their weights, exception phrases, coefficients of the score.
Model = tuple[dict[str, float], tuple[str, ...], list[float] | None]
TOXIC_ROWS, CLEAN_ROWS, TERMS, LEAST_DOCS, LEAST_ODDS = 4_000, 12_000, 5_000, 4, 2.5


def fold(text: str) -> str:
    text = INVISIBLE.sub("", text.lower())
    if not text.isascii():
        text = text.translate(TABLE)
    text = STANDIN.sub(lambda m: m[0].translate(STANDIN_TABLE), text)
    return STRETCHED.sub(r"\1", text)


class Lexicon:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in map(fold, exceptions):
            self.machine.add_word(phrase, (len(phrase), None))
        self.machine.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that stand as words outside exceptions."""
        found, excepted = [], []
        for last, (length, weight) in self.machine.iter(folded):
            start, end = last + 1 - length, last + 1
            if (start == 0 or not folded[start - 1].isalnum()) and (end == len(folded) or not folded[end].isalnum()):
                if weight is None:
                    excepted.append((start, end))
                else:
                    found.append((start, end, weight))
        if not excepted:
            return found
        excepted.sort()
        starts, reach = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        # Of the exceptions that begin no later than a term, the one that reaches furthest tells whether any holds it.
        return [m for m in found if not (k := bisect_right(starts, m[0])) or reach[k - 1] < m[1]]

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weight found, and the weight per hundred words."""
        if not text:
            return 0.0, 0.0
        weight = sum(m[2] for m in self.matches(fold(text)))
        return (float(np.log1p(weight)), 100 * weight / (1 + len(text.split()))) if weight else (0.0, 0.0)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Coefficients, the constant first, by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (labels - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(text, toxic, half) of the bounded sample; the ids, at most that many, are a filter of the scan."""
    usable = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").withColumn("dealt", F.xxhash64("doc_id"))
    rows = [r for kind, n in ((1, toxic_rows), (0, clean_rows)) for r in usable.where(F.col("toxic") == kind).orderBy("dealt", "doc_id").limit(n).collect()]
    ids = sorted({r["doc_id"] for r in rows})
    known = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in rows], "doc_id bigint, toxic int")
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isin(ids)).join(F.broadcast(known), "doc_id")
    return texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))


def words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, half) once for each folded word of a text."""
    for batch in batches:
        texts, toxic, half = (batch.column(c).to_pylist() for c in ("text", "toxic", "half"))
        rows = [(w, y, h) for t, y, h in zip(texts, toxic, half, strict=True) for w in sorted(set(WORD.findall(fold(t or ""))))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["word", "toxic", "half"])


def lexicon_of(counts: DataFrame, size: dict[tuple[int, int], int], halves: list[int], terms: int) -> dict[str, float]:
    """The words of the given halves that documents of label 1 hold more often, with their log odds."""
    t, c = (reduce(Column.__add__, [F.col(f"{kind}{h}") for h in halves]) for kind in "tc")
    n_t, n_c = (sum(size[h, kind] for h in halves) for kind in (1, 0))
    odds = F.log((t + 0.5) / (n_t + 1)) - F.log((c + 0.5) / (n_c + 1))
    best = counts.where((t >= LEAST_DOCS) & (F.length("word") >= 3)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r["word"]: float(r["odds"]) for r in best.orderBy(F.desc("odds"), "word").limit(terms).collect()}


def exceptions_of(rows: DataFrame, weights: dict[str, float], size: dict[tuple[int, int], int], halves: list[int], most: int) -> tuple[str, ...]:
    """The phrases of a term and the word before or after it that speak for label 0, in the given halves."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, ())
        for batch in batches:
            found = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                around = {p for a, b, _ in lexicon.matches(folded) for p in (BEFORE.search(folded, max(0, a - 40), a), AFTER.match(folded, b)) if p for p in [folded[min(p.start(), a) : max(p.end(), b)]]}
                found += [(p, toxic) for p in sorted(around)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["phrase", "toxic"])

    used = rows.where(F.col("half").isin(halves)).select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = used.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    n_t, n_c = (sum(size[h, kind] for h in halves) for kind in (1, 0))
    odds = F.log((F.col("c") + 0.5) / (n_c + 1)) - F.log((F.col("t") + 0.5) / (n_t + 1))
    best = counts.where((F.col("c") >= EXCEPTION_DOCS) & (odds >= EXCEPTION_ODDS)).orderBy(odds.desc(), "phrase").limit(most)
    return tuple(r["phrase"] for r in best.collect())


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, terms: int = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model | None:
    """The lexicon with its weights, the exceptions, given and learned, and the coefficients of the score; None where there are not labels of both kinds."""
    rows = materialise(sample(docs, labels, toxic_rows, clean_rows), "labelled")
    size = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    if min(size.get((half, kind), 0) for half in (0, 1) for kind in (0, 1)) == 0:
        discard(rows)
        return None
    cells = [F.sum(((F.col("half") == h) & (F.col("toxic") == kind)).cast("int")).alias(f"{name}{h}") for h in (0, 1) for name, kind in (("t", 1), ("c", 0))]
    words = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("half").cast("int").alias("half")).mapInArrow(words_once, "word string, toxic int, half int")
    counts = materialise(words.groupBy("word").agg(*cells).where(f"t0 + t1 >= {LEAST_DOCS}"), "words")
    seen = []
    for learned, other in ((0, 1), (1, 0)):
        weights = lexicon_of(counts, size, [learned], terms)
        found = scored(rows, F.col("text"), (weights, (*exceptions, *exceptions_of(rows, weights, size, [learned], terms)), None)).alias("f")
        seen.append(rows.where(F.col("half") == other).select("toxic", found).select("toxic", "f.*").toPandas())
    held = pd.concat(seen)
    weights = lexicon_of(counts, size, [0, 1], terms)
    learned = exceptions_of(rows, weights, size, [0, 1], terms)
    discard(counts, rows)
    return weights, (*exceptions, *learned), logistic(held[["total", "density"]].to_numpy(float), held["toxic"].to_numpy(float))


def scored(df: DataFrame, text: Column, model: Model) -> Column:
    """A struct of total, density and score; the model is of bounded size and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("total double, density double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, exceptions, beta = shared.value
        lexicon = Lexicon(weights, exceptions)
        for texts in batches:
            found = np.array([lexicon.features(t if isinstance(t, str) else None) for t in texts], float).reshape(-1, 2)
            z = np.zeros(len(found)) if beta is None else beta[0] + found @ np.array(beta[1:])
            yield pd.DataFrame({"total": found[:, 0], "density": found[:, 1], "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    return score(text)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    model = fit(docs.where(id_bucket("doc_id", 5) != 0), labels.where(id_bucket("doc_id", 5) != 0))
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    score = F.lit(0.0) if model is None else scored(docs, F.col("text"), model)["score"]
    return docs.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
