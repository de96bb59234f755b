import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import phrases
from docloom.llm.phrases import Members, exact, floored, groups_of, mine_phrases, tokens

from .conftest import ENGLISH


def brute(rows, least, most, top=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    covered = set()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for at in range(1, len(p) - k + 1):
                part = (p[0], *p[at : at + k])
                if 100 * a >= share * found[part]:
                    covered.add(part)
    out = []
    for lang in {p[0] for p in found}:
        scored = []
        for p, a in found.items():
            if p[0] == lang and p not in covered:
                cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some_rows(seed=3, n=60):
    rng = random.Random(seed)
    words = ["Straße", "the", "The", "of", "größe", "ÄRA", "x", "a-b", "don't", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "!", "\x0b", "  "]) for _ in range(rng.randrange(80)))
    return [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" \t\n", "de"), ("one two " * 700, "en"), ("one two " * 3, "en")]


def mined(frame, rows, **options):
    table = frame([(i, text, lang) for i, (text, lang) in enumerate(rows)])
    return sorted(tuple(r) for r in mine_phrases(table, **options).collect())


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"block": 7}, {"broadcast_rows": 0, "block": 16}])
def test_phrases_equal_brute_force(frame, options):
    rows = some_rows()
    assert mined(frame, rows, least=4, **options) == brute(rows, 4, 3)


def test_longer_phrases(frame):
    rows = some_rows(5)
    expected = brute(rows, 3, 5, top=40)
    assert any(r[2].count(" ") == 4 for r in expected)
    assert mined(frame, rows, least=3, most_words=5, top=40, block=32) == expected
    assert mined(frame, rows, least=3, most_words=5, top=40, broadcast_rows=10) == expected


def test_only_words_and_ties(frame):
    rows = [("b a. d c. f e", "en")] * 10
    found = mined(frame, rows)
    assert [r[1:4] for r in found] == [(1, "b a", 10), (2, "d c", 10), (3, "f e", 10)]
    assert {r[-1] for r in found} == {1_000_000}


def test_a_phrase_in_a_longer_one_goes(frame):
    rows = [("p q r", None)] * 10 + [("p q", "und")] * 9
    assert [r[2] for r in mined(frame, rows)] == ["p q r"]
    assert [r[2] for r in mined(frame, rows + [("p q", None)] * 2)] == ["p q", "p q r"]


def test_odd_and_empty_tables(frame, odd, empty):
    assert mine_phrases(empty).collect() == []
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert ENGLISH in [t for t, _ in rows]
    assert sorted(tuple(r) for r in mine_phrases(odd).collect()) == brute(rows, 10, 3)


def test_scores_are_exact(spark):
    a, l, r = 10**15 - 1, 10**15, 10**15 + 3
    from pyspark.sql import functions as F

    assert spark.range(1).select(floored(F.lit(a), F.lit(l), F.lit(r))).first()[0] == 1_000_000 * a * a // (l * r)


def test_members_and_tokens(spark):
    columns = [np.array([1, 1, 5]), np.array([2, 3, 2])]
    rows = [np.array([1, 5, 5, 9, 1]), np.array([3, 3, 2, 2, 2])]
    assert Members(columns).held(rows).tolist() == [True, False, True, False, True]
    assert not Members([np.array([], np.int64)]).held([np.array([4])]).any()
    assert [t for t in tokens("Ab\tc,D\x0be") if t] == [b"ab", b"c", b"\n", b"d", b"\n", b"e"]
    words = spark.createDataFrame([("en", "a", 20), ("de", "a", 3)], "lang string, word string, f bigint")
    assert exact(words, 1, 10) and exact(words.where("f < 10"), 1, 10)
    assert not exact(words.unionAll(words), 1, 10) and exact(words.unionAll(words), 1, 30)


def test_groups():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5):
        columns = [rng.integers(-3, 3, 400) << 60 for _ in range(k)]
        distinct, counts = groups_of(columns)
        assert dict(zip(zip(*[c.tolist() for c in distinct], strict=True), counts.tolist(), strict=True)) == Counter(zip(*[c.tolist() for c in columns], strict=True))


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    """Spark's reader holds a batch of rows, and a row is a block of lists: with 4,096 rows a task held hundreds of MB."""
    name, rows, kept = "spark.sql.parquet.columnarReaderBatchSize", {}, phrases.materialise

    def seen(df, label, *args, **options):
        rows[label] = int(spark.conf.get(name))
        return kept(df, label, *args, **options)

    before = spark.conf.get(name)
    monkeypatch.setattr(phrases, "materialise", seen)
    docs = spark.createDataFrame([(1, "b c d. " * 12, "en")], "doc_id long, text string, lang string")
    for sent in (phrases.BROADCAST_ROWS, 0):
        assert phrases.mine_phrases(docs, broadcast_rows=sent).count() == 1
    assert all(rows[label] <= phrases.BATCH_ROWS for label in ("phrases-2", "phrases-3", "phrases-at-2", "phrase-blocks", "phrase-occurrences", "phrase-regrouped"))
    assert rows["phrase-words"] == int(before) == int(spark.conf.get(name))
