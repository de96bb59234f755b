"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are license notices; they and the documents become sequences of word shingles (hashes of
``SHINGLE`` words; of all words of a shorter template). Templates are put into classes by their number of
shingles, rounded up to a power of two W. A document is cut, per class, into windows of 1.5 W shingles that
start every W/2 (of one shingle for W = 1), so any passage of W shingles lies wholly in one window. A window
that holds the share ``CONTAINMENT`` of a template's shingles has a known least Jaccard similarity to it, and ``bands_for`` gives
the bands, of one MinHash value each, that make a common band miss with a probability below ``MISS``.
Templates retrieved so are verified exactly: the share of their shingles that the window holds. Where matches of
several licenses overlap, the best share stays and ties are listed; a short template inside a longer match goes if
the longer template holds it as well as the text does. ``license_templates.json`` has the templates.

Defined cases: null and wordless texts have no license; a text shorter than a shingle is one shingle; equal
templates under several names report each name; a template that occurs often is reported once with its best
share; an empty template is ignored; repeated rows are scanned one by one; other columns are kept.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-3
CACHED_WORDS = 400_000
WORD = re.compile(r"[^\W_]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "licenses array<struct<name:string, share:double, first_shingle:bigint>>"

#: Fixed texts: licenses in full, their notices, common short forms and SPDX tags (name, text).
TEMPLATES = tuple((name, text) for name, text in json.loads(pkgutil.get_data(__package__, "license_templates.json")))
#: Templates less than this times as long as another compete with it.
COMPARABLE = 2


def bands_for(least_jaccard: float, miss: float = MISS) -> int:
    """Bands of one value, so that all of them differ with a probability below ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - least_jaccard))) if least_jaccard < 1 else 1


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], size: int = SHINGLE, containment: float = CONTAINMENT):
        self.size, self.containment, self.words = size, containment, {}
        self.names = [name for name, _ in templates]
        self.sets: list[np.ndarray] = []
        self.widths: list[int] = []
        self.texts = [text for _, text in templates]
        self.held: dict[tuple[int, int], float] = {}
        classes: dict[tuple[int, int], list[int]] = {}
        for k, (_, text) in enumerate(templates):
            hashes = self.hashes(text)
            width = min(size, len(hashes))
            self.sets.append(np.unique(self.shingles(hashes, width)))
            self.widths.append(width)
            if width:
                classes.setdefault((width, 1 << (len(hashes) - width).bit_length()), []).append(k)
        #: Per class: shingle width, W, shingles that a text needs, MinHash factors, sorted band keys of its templates and whose they are.
        self.classes = []
        for (width, w), members in sorted(classes.items()):
            least = min(self.least_jaccard(len(self.sets[k]), window_of(w)) for k in members)
            factors = np.random.default_rng(w).integers(1, 2**63, bands_for(least), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys = np.concatenate([self.bands(self.mixed(self.sets[k], factors).min(axis=0)[None]).ravel() for k in members])
            owner = np.repeat(members, len(factors))
            order = np.argsort(keys, kind="stable")
            heads = np.zeros(1 << 16, bool)
            heads[keys >> np.uint64(48)] = True
            needed = min(math.ceil(self.containment * len(self.sets[k]) - 1e-9) for k in members)
            self.classes.append((width, w, needed, factors, keys[order], owner[order], heads))

    def least_jaccard(self, size: int, window: int) -> float:
        """Of a template of ``size`` shingles and a window that holds the least share of them."""
        held = math.ceil(self.containment * size - 1e-9)
        return held / (max(window, held) + size - held)

    def hashes(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode()) - 2**63
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(hashes) - width + 1) if width else 0
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = (out ^ hashes[i : i + n]) * ODD
            out ^= out >> np.uint64(31)
        return out

    @staticmethod
    def mixed(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return shingles[:, None] * factors[None, :]

    @staticmethod
    def bands(least: np.ndarray) -> np.ndarray:
        """Band keys of rows of MinHash values: the value with the number of its band."""
        return (least ^ np.arange(least.shape[1], dtype=np.uint64)) * ODD

    def matches(self, text: str | None) -> Iterator[tuple[int, float, int, int, int]]:
        """(template, share of its shingles, first shingle of the window, first and last of its shingles there)."""
        hashes = self.hashes(text) if text else np.zeros(0, np.uint64)
        sequences: dict[int, np.ndarray] = {}
        for width, w, needed, factors, keys, owner, heads in self.classes:
            sequence = sequences[width] if width in sequences else sequences.setdefault(width, self.shingles(hashes, width))
            if len(sequence) < needed:
                continue
            length = min(4096 * w, max(4 * w, 1 << 18))
            for start in range(0, len(sequence), length):
                part = sequence[start : start + length + w]
                for at, k in retrieve(part, w, self.mixed(part, factors), keys, owner, heads):
                    window = part[at : at + window_of(w)]
                    share = float(np.isin(self.sets[k], window).mean())
                    if share >= self.containment:
                        places = np.flatnonzero(np.isin(window, self.sets[k]))
                        yield k, share, start + at, start + at + int(places[0]), start + at + int(places[-1]) + width - 1

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(license, share of its shingles, first shingle of the window) of each license that matches."""
        return self.best(self.matches(text))

    def found(self, text: str | None) -> list[tuple[str, float, int]]:
        """As ``scan``, without matches that another license explains better."""
        kept: dict[tuple[int, int, int], tuple] = {}
        for m in self.matches(text):
            known = kept.get((m[0], *m[3:]))
            if known is None or (m[1], -m[2]) > (known[1], -known[2]):
                kept[m[0], *m[3:]] = m
        if len({self.names[m[0]] for m in kept.values()}) < 2:
            return self.best(kept.values())
        rows = sorted(kept.values(), key=lambda m: m[3])
        lost: set[int] = set()
        open_: list[int] = []
        for j, m in enumerate(rows):
            open_ = [i for i in open_ if rows[i][4] >= m[3]]
            for i in open_:
                if self.explains(rows[i], m):
                    lost.add(j)
                if self.explains(m, rows[i]):
                    lost.add(i)
            open_.append(j)
        return self.best(m for j, m in enumerate(rows) if j not in lost)

    def explains(self, other: tuple, m: tuple) -> bool:
        """Whether ``other``, of another license, overlaps most of the shorter of both and is the better match: of comparable
        lengths that of the higher share, else the longer one if its template holds as much of the shorter as the text does."""
        if self.names[other[0]] == self.names[m[0]] or 2 * (min(other[4], m[4]) - max(other[3], m[3]) + 1) < min(other[4] - other[3], m[4] - m[3]) + 1:
            return False
        a, b = len(self.sets[other[0]]), len(self.sets[m[0]])
        if max(a, b) < COMPARABLE * min(a, b):
            return other[1] > m[1] + 1e-9
        return a > b and self.holds(other[0], m[0]) >= m[1] - 1e-9

    def holds(self, k: int, part: int) -> float:
        """The share of the shingles of template ``part`` that template ``k`` holds."""
        if (k, part) not in self.held:
            self.held[k, part] = float(np.isin(self.sets[part], self.shingles(self.hashes(self.texts[k]), self.widths[part])).mean())
        return self.held[k, part]

    def best(self, matches: Iterable[tuple]) -> list[tuple[str, float, int]]:
        best: dict[str, tuple[float, int]] = {}
        for k, share, at, *_ in matches:
            known = best.get(self.names[k], (0.0, 0))
            if (share, -at) > (known[0], -known[1]):
                best[self.names[k]] = (share, at)
        return sorted((name, share, at) for name, (share, at) in best.items())


def window_of(w: int) -> int:
    return w + w // 2


def retrieve(part: np.ndarray, w: int, mixed: np.ndarray, keys: np.ndarray, owner: np.ndarray, heads: np.ndarray) -> list[tuple[int, int]]:
    """(start of a window, template) for windows that share a band with a template."""
    step = max(1, w // 2)
    least = mixed
    if w > 1:
        blocks = np.minimum.reduceat(mixed, np.arange(0, len(part), step), axis=0)
        least = blocks.copy()
        for k in range(1, window_of(w) // step):
            np.minimum(least[:-k], blocks[k:], out=least[:-k])
    bands = Scanner.bands(least)
    windows, band = np.nonzero(heads[bands >> np.uint64(48)])
    found = set()
    for x, key in zip(windows.tolist(), bands[windows, band], strict=True):
        i, j = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        found.update((x * step, int(k)) for k in owner[i:j])
    return sorted(found)


def find_licenses(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` with a last column of its own: the licenses found, each with its best share and place."""
    name = free_name(docs, "found")

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for texts in batches:
            yield pd.DataFrame({"licenses": [[{"name": n, "share": s, "first_shingle": at} for n, s, at in scanner.found(t if isinstance(t, str) else None)] for t in texts]})

    return docs.withColumn(name, scan(F.col(text)))


def op8_license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, comma-joined), best_share of every row of ``documents``."""
    found = find_licenses(docs.select("doc_id", "text")).select("doc_id", F.col("found.licenses").alias("l"))
    return found.select(
        "doc_id", F.size("l").cast("bigint").alias("n_licenses"), F.array_join(F.transform("l", lambda x: x["name"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("l", lambda x: x["share"])), F.lit(0.0)).alias("best_share"),
    )
