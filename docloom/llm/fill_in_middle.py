"""Fill-in-middle transformation over a Roaring-style set of token boundaries.

The ends of a text's tokens are a sorted set of code point offsets. Each block of 65,536 offsets is a container: an array of
offsets where they are few, runs where they are mostly neighbours, else a bitmap, whichever is smallest. Containers carry cumulative
cardinalities, so the offset after the first k tokens takes one search over containers and one selection inside: on an array by
place, on runs over their cumulative lengths, on a bitmap over the counts of its words. A text is read in blocks of the same size, so no list of
its tokens is ever built.

A text becomes plain, psm or spm by hashes of its id. Sentinels begin with a character that none of them repeats, so in an output of pieces
without sentinels they occur exactly where they were put, and ``restore`` is exact.

Defined cases: null text is an empty one; an empty text and one that holds a sentinel stay plain; a null id hashes as the empty
string; rows that repeat an id are cut by the same hashes; other columns are kept, and the results are one struct in a free name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name

RATE, SPM_SHARE, SEED = 50, 80, 42
SENTINELS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 16
#: Bytes of a container as a bitmap.
BITMAP_BYTES = BLOCK // 8
RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Container:
    """Up to 65,536 sorted offsets of one block: ``kind`` says how ``data`` holds them."""

    kind: str
    data: np.ndarray
    #: Counts up to and with each run, or each word of the bitmap.
    upto: np.ndarray | None = None

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        """The smallest container of the sorted ``low``, which is not empty."""
        first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
        if len(first) * 4 < min(len(low) * 2, BITMAP_BYTES):
            return cls("run", low[first], np.append(first[1:], len(low)))
        if len(low) * 2 <= BITMAP_BYTES:
            return cls("array", low.astype(np.uint16))
        bits = np.zeros(BLOCK, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls("bitmap", words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def select(self, k: int) -> int:
        """The ``k``-th offset, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.upto, k, "right"))
        rest = k - (int(self.upto[at - 1]) if at else 0)
        if self.kind == "run":
            return int(self.data[at]) + rest
        word = self.data[at : at + 1].view(np.uint8)
        return at * 64 + int(np.flatnonzero(np.unpackbits(word, bitorder="little"))[rest])


@dataclass
class BoundarySet:
    """Containers in the order of their keys with cumulative cardinalities."""

    keys: list[int] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)
    upto: list[int] = field(default_factory=list)

    def add(self, key: int, low: np.ndarray) -> None:
        if len(low):
            self.keys.append(key)
            self.containers.append(Container.of(low))
            self.upto.append(len(self) + len(low))

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        return self.keys[at] * BLOCK + self.containers[at].select(k - (self.upto[at - 1] if at else 0))

    def cut(self, units: int) -> int:
        """The offset after the first ``units`` tokens."""
        return self.select(units - 1) if units else 0


def boundaries(text: str) -> BoundarySet:
    """Ends of the tokens of ``text``: blanks with the word after them, or blanks that end the text."""
    found, blank, n = BoundarySet(), True, len(text)
    for key in range(n // BLOCK + 1):
        codes = np.frombuffer(text[key * BLOCK : (key + 1) * BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        now = (codes == 32) | ((codes >= 9) & (codes <= 13))
        ends = np.flatnonzero(now & ~np.concatenate(([blank], now[:-1]))) if len(codes) else np.empty(0, np.int64)
        if n and n // BLOCK == key:
            ends = np.append(ends, n % BLOCK)
        found.add(key, ends)
        blank = bool(now[-1]) if len(codes) else blank
    return found


def transform(text: str, name: str, rate: int, spm_share: int, seed: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    h1, h2, h3, h4 = (int(g, 16) for g in _groups(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()))
    found = boundaries(text)
    n = len(found)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = (found.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = sentinels
    if h4 % 100 < spm_share:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def _groups(digest: str) -> list[str]:
    return [digest[k : k + 8] for k in range(0, 32, 8)]


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """``sentinels`` if they are fit to be found again: different, each beginning with a character that none of them repeats."""
    firsts = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or "" in firsts or any(c in s[1:] for s in sentinels for c in firsts) or any(a != b and a.startswith(b) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three different texts that begin with a character that none of them repeats")
    return sentinels


def fill_in_middle(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` and, last, a struct of its own: n, form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts that can be cut are cut, and ``spm_share`` percent of these put the suffix first.
    """
    marks = checked(sentinels)

    @F.pandas_udf(RESULT)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            rows = [transform(t or "", name or "", rate, spm_share, seed, marks) for t, name in zip(texts, names, strict=True)]
            frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(free_name(docs, "fim"), made(F.col(text), F.col(id_col).cast("string")))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in checked(sentinels)), -1)
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of ``documents``."""
    made = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    rebuilt = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", rebuilt))])


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS a, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, len(a) AS n, least(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS lo, greatest(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(a[1:lo], '') AS p, array_to_string(a[lo + 1:hi], '') AS m, array_to_string(a[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""
