import hashlib
import random
import re

import pytest

from docloom.llm import decontamination as d

from ..helpers import same_as_sql, tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_force(text, items):
    mine, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for i in range(len(mine) - k + 1):
                if mine[i : i + k] == w[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
    ids = ",".join(sorted(found))
    return len(mine), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = ["Äb", "b", "C9", "dd", "é"]
    def some(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([10, 11, 25, 3, 1, 9, 40])] + [(7, ""), (8, None), (9, "…"), (10, "zz " * 12), (11, "zz " * 12)]
    docs = [(i, some(rng.randrange(60))) for i in range(40)] + [(100 + i, f"q {t} q") for i, t in items if t] + [(200, None), (201, ""), (202, "zz-" * 30)]
    return docs, items


@pytest.mark.parametrize("max_windows", [200_000, 5])
def test_equals_brute_force(spark, frame, case, max_windows):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.find_windows(frame(docs), bench, max_windows=max_windows)
    name = found.columns[-1]
    assert name == "_matches"
    for row in found.collect():
        n, hit, k, _, _ = brute_force(dict(docs)[row["doc_id"]], items)
        m = row[name]
        assert (m["n_words"], sum(s["past"] - s["first"] for s in m["spans"]), len(m["items"])) == (n, hit, k)
    for row in d.op4_decontamination(frame(docs), bench).collect():
        assert tuple(row)[1:] == brute_force(dict(docs)[row["doc_id"]], items)


def test_shards_leave_other_columns_alone(spark, frame):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(str(i), " ".join(words[i : i + 12])) for i in range(40)] + [("x", " ".join(words[:12]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "s1", " ".join(words), "a"), (1, "s1", " ".join(words), "b"), (2, "s2", None, "c"), (3, "s3", "w1 w2", "d")], "doc_id bigint, h1 string, text string, spans string")
    one, many = ({(r["doc_id"], r["spans"]): r["matches"] for r in d.find_windows(docs, bench, max_windows=n).collect()} for n in (10_000, 7))
    assert one == many and len(one) == 4 and len(one[1, "a"]["items"]) == 41 and one[2, "c"]["n_words"] == 0
    assert d.find_windows(docs, bench, max_windows=7).columns == [*docs.columns, "matches"]


def test_equals_sql(spark, sf_dir):
    out = d.op4_decontamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    same_as_sql(out, tables(sf_dir), d.OP4_SQL)


def test_odd_rows_and_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog and then"), (1, None)], "item_id bigint, text string")
    assert d.op4_decontamination(odd, none).where("contaminated").count() == 0
    rows = d.op4_decontamination(odd, some)
    assert rows.count() == 14 and rows.where("contaminated AND n_items = 0 AND n_hit >= 11").count() == 6
    kept = d.keep_clean(odd, some)
    assert kept.columns == odd.columns and kept.count() == 8
    assert d.op4_decontamination(empty, some).count() == 0
