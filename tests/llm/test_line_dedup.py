import hashlib
from collections import defaultdict

import pytest

from docloom.llm import line_dedup as ld

from ..helpers import same_as_sql, tables

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "this line is long enough É"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute_force(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        order = [-(10**9) if x is None else x for x in [doc_id]][0]
        gone = [len(holders[key(x)]) >= 3 and max(-(10**9) if h is None else h for h in holders[key(x)]) != order if len(key(x)) >= 20 else False for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc_id, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ROWS = [
    (1, f"{LONG}\nshort\n{LONG}"), (2, f" \t{LONG.upper().replace('É', 'É')} \r\nx"), (3, LONG), (4, LONG.replace("É", "é")), (5, LONG.replace("É", "é")), (6, f"{LONG}\n\n"), (6, f"{LONG}\nother row of one id"),
    (7, "exactly twenty chars"), (8, "Exactly twenty chars"), (9, "exactly twenty chars\n"), (10, "nineteen characters"), (11, "nineteen characters"), (12, "nineteen characters"),
    (13, None), (14, ""), (None, f"{LONG}\n{LONG}"), (None, None), (15, "only in two documents here"), (16, "only in two documents here"), (17, "twice in one row, one id ok\ntwice in one row, one id ok\ntwice in one row, one id ok"),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (4, 3), (5, 2)])
def test_equals_brute_force(frame, batches, fanout):
    found = ld.dedup_lines(frame(ROWS).repartition(3), batches=batches, fanout=fanout)
    name = found.columns[-1]
    assert name == "_lines"
    out = [(r["doc_id"], r[name]["n_lines"], r[name]["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found.collect()]
    assert sorted(out, key=str) == sorted(brute_force(ROWS), key=str)


def test_equals_sql(spark, sf_dir):
    same_as_sql(ld.op5_line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")), tables(sf_dir), ld.OP5_SQL)


def test_runs_are_levelled(spark):
    store = ld.LineRuns(spark, fanout=2)
    for i in range(5):
        store.add(spark.createDataFrame([(4 - i, 1, 1), (4 - i, i, 9)], "id bigint, h1 bigint, h2 bigint"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert {(r["h1"], r["h2"]): (r["n_docs"], r["last_id"]) for r in store.counts().collect()}[1, 1] == (5, 4)
    seen = store.unseen(spark.createDataFrame([(1, 1), (7, 7)], "h1 bigint, h2 bigint")).collect()
    assert sorted(tuple(r) for r in seen) == [(1, 1, False), (7, 7, True)]
    store.clear()
    assert store.rows() is None


def test_a_batch_adds_only_unseen_keys_to_the_runs(spark):
    """Every key has one owner: without the anti-join each batch would own the keys it repeats."""
    store = ld.LineRuns(spark, fanout=3)
    for i in range(4):
        store.add(spark.createDataFrame([(i, 1, 1), (i, 2, 2 + i)], "id bigint, h1 bigint, h2 bigint"))
    rows = [tuple(r) for r in store.rows().collect()]
    assert sorted((h1, h2) for h1, h2, _, _, owned in rows if owned) == [(1, 1), (2, 2), (2, 3), (2, 4), (2, 5)]
    assert [r[:3] for r in rows if not r[-1]] == [(1, 1, 1)]
    assert all(len(level) < 3 for level in store.levels)


def test_the_anti_join_decides_which_document_keeps_a_line(frame, monkeypatch):
    """If every batch owned all its keys, an earlier document would keep what the last one holds."""
    rows = [(i, f"{'the line that all of them hold'}\nline number {i} of its own, long enough") for i in range(40)]
    right = {r.doc_id: r.n_dropped for r in ld.op5_line_dedup(frame(rows)).collect()}
    assert right == {i: int(i < 39) for i in range(40)}
    monkeypatch.setattr(ld.LineRuns, "unseen", lambda self, keys: keys.withColumn("owned", ld.F.lit(True)))
    wrong = {r.doc_id: r.n_dropped for r in ld.op5_line_dedup(frame(rows)).collect()}
    assert wrong[39] == 1 and wrong != right


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    store = ld.LineRuns(spark, fanout=9)
    keys = "id bigint, h1 bigint, h2 bigint"
    for i in range(2):
        store.add(spark.createDataFrame([(9 - i, k, k) for k in range(50 + i)], keys))
    counts = spark.createDataFrame([(1, k, k) for k in range(80)], keys).groupBy("h1", "h2").agg(ld.F.count("*").alias("n_docs"), ld.F.max("id").alias("last_id"))
    with ld.ordered_scans(spark):
        plan = store.unseen(counts)._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in store.unseen(counts).collect())
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "FileScan parquet" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                above = [x for x in lines[:k] if len(x) - len(x.lstrip(" :+-")) < depth]
                up = []  # the way from the scan to its join
                for x in reversed(above):
                    if not up or len(x) - len(x.lstrip(" :+-")) < len(up[-1]) - len(up[-1].lstrip(" :+-")):
                        up.append(x)
                way = up[: next(n for n, x in enumerate(up) if "SortMergeJoin" in x)]
                assert not [x for x in way if "Exchange" in x or " Sort " in x], plan
        assert sum("SortMergeJoin" in x for x in lines) == 2
    assert [r[-1] for r in rows] == [k >= 51 for k in range(80)]
    store.clear()


def test_owners_with_enough_need_no_additions(spark):
    keys = "id bigint, h1 bigint, h2 bigint"
    store = ld.LineRuns(spark, 3, enough=2)
    store.add(spark.createDataFrame([(9, 1, 1), (8, 1, 1), (8, 2, 2)], keys))
    store.add(spark.createDataFrame([(5, 1, 1), (5, 2, 2)], keys))
    assert sorted(tuple(r) for r in store.rows().collect()) == [(1, 1, 2, 9, True), (2, 2, 1, 5, False), (2, 2, 1, 8, True)]
    assert sorted(tuple(r) for r in store.counts().collect()) == [(1, 1, 2, 9), (2, 2, 2, 8)]
    store.clear()


def test_batches_are_descending_ranges(spark):
    rows = spark.createDataFrame([(i,) for i in range(1000)] + [(None,)], "id bigint")
    cuts = ld.id_cuts(rows, "id", 4)
    found = rows.select("id", ld.batch_of(cuts).alias("b")).collect()
    assert len(cuts) == 3 and cuts == sorted(cuts, reverse=True)
    by_id = sorted(((r.id, r.b) for r in found if r.id is not None), reverse=True)
    assert [b for _, b in by_id] == sorted(b for _, b in by_id) and {b for _, b in by_id} == {0, 1, 2, 3}
    assert [r.b for r in found if r.id is None] == [3]
    assert ld.id_cuts(rows.where("id IS NULL"), "id", 4) == []


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, ld.op5_line_dedup(odd).collect()), key=str) == sorted(brute_force(rows), key=str)
    assert ld.op5_line_dedup(empty).count() == 0
    rewritten = ld.rewrite_lines(odd)
    assert rewritten.columns == odd.columns and rewritten.where("n_chars <> length(text)").count() == 0
    assert ld.rewrite_lines(empty).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = ld.op5_line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
