import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm.fill_in_middle import BLOCK, BoundarySet, Container, boundaries, checked, fill_in_middle, op13_fill_in_middle, restore

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def ends(text):
    return np.cumsum([len(t) for t in TOKEN.findall(text)]).tolist()


@given(st.text(alphabet=" \t\n\x0b\x0c\rab<P>é😀 "))
@settings(max_examples=200, deadline=None)
def test_boundaries(text):
    found = boundaries(text)
    assert [found.select(k) for k in range(len(found))] == ends(text)


@pytest.mark.parametrize("text", ["a " * BLOCK, "ab" * BLOCK, " " * (2 * BLOCK), "x" * (BLOCK - 1) + " y", "x" * BLOCK + " y", "a b" * 50_000 + " " * 70_000 + "long " * 30_000])
def test_boundaries_of_long_texts(text):
    found, expected = boundaries(text), ends(text)
    assert len(found) == len(expected)
    some = sorted({*range(0, len(expected), 997), len(expected) - 1})
    assert [found.select(k) for k in some] == [expected[k] for k in some]
    assert found.cut(0) == 0


@pytest.mark.parametrize("low, kind", [(np.arange(0, BLOCK, 40), "array"), (np.arange(500, 60_000), "run"), (np.arange(0, BLOCK, 2), "bitmap"), (np.array([65_535]), "array"), (np.arange(BLOCK), "run")])
def test_containers(low, kind):
    made = Container.of(low)
    assert made.kind == kind
    assert [made.select(k) for k in range(0, len(low), 101)] == low[::101].tolist()
    assert made.select(len(low) - 1) == low[-1]


def test_set_over_several_kinds():
    parts = {0: np.arange(0, BLOCK, 3), 2: np.arange(7, 900), 9: np.array([1, 5])}
    made = BoundarySet()
    for key, low in parts.items():
        made.add(key, low)
    made.add(11, np.array([], np.int64))
    expected = np.concatenate([low + key * BLOCK for key, low in parts.items()])
    assert len(made) == len(expected) and [made.select(k) for k in range(len(made))] == expected.tolist()


def test_rows_equal_brute_force(frame, odd):
    rows = [(k, f"some words {k} and <S> more\n" if k % 7 == 0 else f" é {k}\tto <P be😀 cut  <  " * (k % 9), "en") for k in range(120)]
    table = frame(rows).unionByName(odd)
    found = fill_in_middle(table).select("doc_id", "text", "fim.*", restore(F.col("fim.output"), F.col("fim.form")).alias("back"), "digest").collect()
    assert len(found) == 134 and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.digest == "x"


def test_query_digests(frame, empty):
    assert op13_fill_in_middle(empty).collect() == []
    row = next(r for r in op13_fill_in_middle(frame([(k, "one two three four", "en") for k in range(20)])).collect() if r.form != "plain")
    assert row.output_sha256 == hashlib.sha256(brute(row.doc_id, "one two three four")[-1].encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(b"one two three four").hexdigest()


def test_other_rates_and_sentinels(frame):
    table = frame([(k, "a b c d", "en") for k in range(40)])
    marks = ("[pre]", "[suf]".replace("[", "{"), "(mid)")
    made = fill_in_middle(table, rate=100, spm_share=0, sentinels=marks)
    assert {r.form for r in made.select("fim.form").collect()} == {"psm"}
    assert all(r[0] == "a b c d" for r in made.select(restore(F.col("fim.output"), F.col("fim.form"), marks)).collect())
    assert {r.form for r in fill_in_middle(table, rate=0).select("fim.form").collect()} == {"plain"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "c", "d"), ("<P", "<PS", "<M>"), ("x<", "<S>", "<M>")])
def test_sentinels_that_cannot_be_found_again(marks):
    with pytest.raises(ValueError):
        checked(marks)
