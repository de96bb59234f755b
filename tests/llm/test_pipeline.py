import importlib
import sys

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from docloom.llm import sentencepiece_codec as sc  # noqa: E402

from .test_decontamination import brute_force as benchmark_hits  # noqa: E402
from .test_jaccard_join import brute_force as classes  # noqa: E402
from .test_line_dedup import key  # noqa: E402


def dedup_lines(rows):
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i)) for i, t in rows]


def test_rows_equal_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = dedup_lines([(i, t) for i, t in rows if t and any(c.isalpha() for c in t)])
    rows = [(i, t) for (i, t), (_, first, _) in zip(rows, classes(rows), strict=True) if first == i]
    rows = [(i, t) for i, t in rows if not benchmark_hits(t, items)[-1]]
    codec = sc.Pieces.load(sc.MODEL)
    found = pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted((i, codec.encode(t).tolist()) for i, t in rows)


def test_rows_of_the_stages_on_an_odd_table(spark, sf_dir, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    ids = lambda found: sorted(str(r["doc_id"]) for r in found.collect())
    stages = dict(pipeline.STAGES)
    lettered = [i for i, t in rows if t and any(c.isalpha() for c in t)]
    assert ids(stages["language_id"](spark, odd, sf_dir)) == sorted(map(str, lettered))
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in stages["line_dedup"](spark, odd, sf_dir).collect())
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= 3}
    assert texts == sorted((str(i), "\n".join(x for x in (t or "").split("\n") if last.get(key(x), i) == i)) for i, t in rows)
    wordless = [i for i, t in rows if not (t or "").split()]
    assert ids(stages["jaccard_join"](spark, odd, sf_dir)) == sorted(map(str, [*wordless, 4, 5, 6, 8]))
    assert stages["decontamination"](spark, odd, sf_dir).count() == len(rows)
    assert ids(stages["sentencepiece"](spark, odd, sf_dir)) == sorted(str(i) for i, _ in rows)


def test_stages_keep_the_columns(spark, sf_dir, odd, empty):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    for docs in (odd, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.collect()
            assert name == "sentencepiece" or out.columns == docs.columns


def test_entry_has_the_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    names = {n for n in entry.queries() if n.startswith("op")}
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()
    assert "docloom.llm" in sys.modules
