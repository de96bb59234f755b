"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``WINDOW`` consecutive words of each benchmark item (the whole item where it
is shorter). Patterns of one length share a shift table over blocks of two words: a block that ends no
pattern says how many words can be skipped. A block with shift 0 selects a bucket of patterns by the hash
of that block and of the first word, and a comparison word by word confirms the occurrence.

Windows are cut, made distinct and dealt into shards of about ``max_windows`` by Spark; the driver sees one shard at a time, to broadcast it.
With several shards the documents are passed over once for each, and only what was found is written, by the hash of the text; all that
was found meets the documents in the end. So memory stays bounded however large the benchmark is.

Defined cases: null or wordless text has no words and is clean; a wordless item has no window; equal
windows of several items report every item; items without an id mark words but are not listed; overlapping
occurrences count a word once; repeated documents are searched one by one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import content_key, discard, free_name, materialise

WINDOW, BLOCK = 10, 2
#: A-Z become a-z, every other ASCII character that is no letter or digit a space; UTF-8 bytes above 7F stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SPANS = "array<struct<first:bigint, past:bigint>>"
MATCH = f"n_words bigint, spans {SPANS}, items array<string>"
#: A word in a text whose capitals are not yet folded.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """The search over patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], frozenset[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[int, list[tuple[list[bytes], frozenset[str]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.buckets.setdefault(pattern[-self.block :], {}).setdefault(hash(pattern[0]), []).append((list(pattern), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """The first word of each occurrence and the items of its pattern."""
        end, n, block, length, most = self.length, len(words), self.block, self.length, self.most
        shift = self.shift.get
        while end <= n:
            key = tuple(words[end - block : end])
            skip = shift(key, most)
            if skip:
                end += skip
                continue
            first = end - length
            for pattern, items in self.buckets[key].get(hash(words[first]), ()):
                if words[first:end] == pattern:
                    yield first, items
            end += 1


def search(tables: list[WuManber], text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, disjoint spans of hit words, items found."""
    words, spans, items = words_of(text), [], set()
    for table in tables:
        for first, found in table.occurrences(words):
            spans.append((first, first + table.length))
            items |= found
    return len(words), join_spans(spans), sorted(items)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def tables_of(windows: list[tuple[str | None, tuple[bytes, ...]]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, window in windows:
        by_length.setdefault(len(window), {}).setdefault(window, set()).update([item] if item is not None else [])
    return [WuManber(n, {k: frozenset(v) for k, v in found.items()}) for n, found in sorted(by_length.items())]


_built: dict[str, list[WuManber]] = {}


def finder(shared: Broadcast, key: str) -> Callable:
    """The search for the broadcast windows as a function of a text column."""

    @F.pandas_udf(MATCH)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _built:
            _built.clear()
            _built[key] = tables_of(shared.value)
        for texts in batches:
            yield pd.DataFrame([search(_built[key], t if isinstance(t, str) else None) for t in texts], columns=["n_words", "spans", "items"])

    return matches


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = 200_000) -> DataFrame:
    """``docs`` with a last column of its own: a struct of n_words, spans of hit words and items found."""
    context = docs.sparkSession.sparkContext
    name = free_name(docs, "matches")
    windows = materialise(distinct_windows(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))), "windows")
    shards = max(1, -(-windows.count() // max_windows))
    shard = F.pmod(F.xxhash64("item", "window"), F.lit(shards))

    def finder_of(k: int) -> Callable:
        rows = sorted(((r["item"], tuple(bytes(r["window"]).split())) for r in windows.where(shard == k).collect()), key=lambda r: (r[1], r[0] or "", r[0] is None))
        return finder(context.broadcast(rows), content_key(rows))

    if shards == 1:
        found = docs.withColumn(name, finder_of(0)(F.col(text)))
        discard(windows)
        return found
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    hits = []
    for k in range(shards):
        seen = docs.select(*key, finder_of(k)(F.col(text)).alias("m")).where(F.size("m.spans") > 0)
        hits.append(materialise(seen.select("h1", "h2", "m.spans", "m.items"), "matches"))
    discard(windows)
    together = reduce(DataFrame.unionByName, hits).groupBy("h1", "h2").agg(F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    one = materialise(together.select("h1", "h2", joined(F.flatten("spans")).alias("spans"), "items"), "hits")
    discard(*hits)
    h1, h2 = free_name(docs, "h1"), free_name(docs, "h2")
    keyed = docs.withColumns({h1: key[0], h2: key[1]})
    both = keyed.join(one, (keyed[h1] == one["h1"]) & (keyed[h2] == one["h2"]), "left")
    spans, items = (F.coalesce(one[c], F.array().cast(kind)) for c, kind in (("spans", SPANS), ("items", "array<string>")))
    n_words = F.coalesce(F.regexp_count(keyed[text], F.lit(WORDS)), F.lit(0)).cast("bigint")
    return both.select(*[keyed[f"`{c}`"] for c in docs.columns], F.struct(n_words.alias("n_words"), spans.alias("spans"), items.alias("items")).alias(name))


def distinct_windows(items: DataFrame) -> DataFrame:
    """(item, window) once each; the words of a window are joined by blanks, which no word holds."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(item, b" ".join(w)) for item, text in zip(frame["item"], frame["text"], strict=True) for w in windows_of(words_of(text if isinstance(text, str) else None))]
            yield pd.DataFrame(rows, columns=["item", "window"])

    return items.mapInPandas(cut, "item string, window binary").distinct()


def joined(spans: Column) -> Column:
    """Disjoint spans in order that cover the given ones."""

    @F.pandas_udf(SPANS)
    def join(lists: pd.Series) -> pd.Series:
        return lists.map(lambda spans: [{"first": a, "past": b} for a, b in join_spans([(s["first"], s["past"]) for s in spans])])

    return join(spans)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    found = find_windows(docs, benchmark, text)
    return found.where(F.size(F.col(found.columns[-1])["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``documents``."""
    found = find_windows(docs.select("doc_id", "text"), benchmark).select("doc_id", "matches.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
gram AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc CROSS JOIN size WHERE len(w) >= k)),
hit AS (SELECT r, item_id, i, k FROM gram JOIN win USING (k, g)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
