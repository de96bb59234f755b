import math
import random

import numpy as np
import pytest

from docloom.llm import jaccard_join as jj


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(rows):
    """class id and links of each row, in the order given."""
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= 0.8 * (len(sets[i] | sets[j])) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(doc_id, least[find(i)], links[i]) for i, (doc_id, _) in enumerate(rows)]


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        yield " ".join(copy)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [t for size, words, edits in ((40, 120, 2), (12, 60, 2), (5, 8, 1), (30, 300, 12), (20, 40, 3)) for t in family(rng, size, words, edits)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'q{rng.randrange(10**6)}' for _ in range(50))} {passage}" for _ in range(30)]
    texts += ["One", "one", "two words", "", None, texts[0], texts[0].upper()]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("bucket", "block"), [(128, 256), (3, 4)])
def test_equals_brute_force(frame, rows, monkeypatch, bucket, block):
    monkeypatch.setattr(jj, "BUCKET", bucket)
    monkeypatch.setattr(jj, "BLOCK", block)
    found = jj.op2_jaccard_join(frame(rows).repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(brute_force(rows))


def test_equals_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, jj.op2_jaccard_join(docs).collect())) == sorted(brute_force(rows))


def test_odd_rows(odd, empty):
    found = jj.op2_jaccard_join(odd)
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert found.count() == 14
    assert out[5] == [(5, 5), (5, 5)] and out[7] == out[9] == out[11] == [(5, 5)] and (5, 5) in out[None]
    assert out[1] == [(1, 0)] and out[2] == [(2, 0)] and (None, 0) in out[None] and out[6] == out[10] == [(6, 1)]
    assert jj.op2_jaccard_join(empty).count() == 0


def test_stage_keeps_one_of_each_class(odd, empty):
    kept = jj.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, None]))
    assert jj.keep_one(empty).count() == 0


def test_runs_reach_the_recall():
    runs = jj.runs_for(0.999, 0.8, 3)
    assert 1 - (1 - 0.8**3) ** runs >= 0.999 > 1 - (1 - 0.8**3) ** (runs - 1)


@pytest.mark.parametrize("size", [5, 9, 20, 60, 300, 2_000])
def test_sketches_discard_no_pair_at_the_threshold(size):
    """How often the sketches of a pair at the threshold fall below what they must reach, by the size of the sets."""
    rng, missed, tried = np.random.default_rng(size), 0, 2_000 if size < 1_000 else 400
    shared = math.ceil(jj.THRESHOLD * 2 * size / (1 + jj.THRESHOLD))
    for _ in range(tried):
        tokens = rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
        x, y = (np.frombuffer(jj.sketch(np.sort(t)), np.uint8) for t in (tokens[:size], np.concatenate([tokens[:shared], tokens[size:]])))
        missed += ((x == y) & (x > 0)).sum() < (jj.THRESHOLD - jj.SKETCH_MARGIN) * ((x > 0) | (y > 0)).sum()
    assert missed <= 0.001 * tried
