import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import language_id as li
from docloom.llm.common import read_table

texts = st.text(alphabet="abcdé 1", max_size=60)


def longest_match_phrases(reference, text):
    """Phrases of ``text``, lane by lane, by trying every length against the training text."""
    count = 0
    for start in range(0, len(text), li.PIECE):
        lane = text[start : start + li.PIECE]
        at = 0
        while at < len(lane):
            end = at + 1
            while end < len(lane) and lane[at : end + 1] in reference:
                end += 1
            count, at = count + 1, end
    return count


def letters_only(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return f" {' '.join(words)} " if words else ""


def brute_force(profiles, text):
    """Language and score of a text by the definition."""
    read = letters_only(text or "")
    if not read:
        return "und", 0.0
    costs = {k: longest_match_phrases(letters_only(p), read) * math.log2(max(2, len(letters_only(p)))) for k, p in profiles.items()}
    best = min(costs, key=lambda k: (costs[k], k))
    return best, 1 / sum(2.0 ** max(costs[best] - c, -1000) for c in costs.values())


@settings(deadline=None)
@given(texts)
def test_read_is_letters_and_single_blanks(text):
    assert "".join(chr(c) if c else " " for c in li.read(text)) == letters_only(text)


@settings(deadline=None)
@given(texts, texts, st.lists(texts, max_size=5))
def test_phrases_equal_brute_force(a, b, many):
    profiles = {k: t for k, t in (("a", a), ("b", b)) if letters_only(t)}
    if profiles:
        found = li.Identifier(profiles).phrases([li.read(t) for t in many])
        assert found.tolist() == [[longest_match_phrases(letters_only(p), letters_only(t)) for p in profiles.values()] for t in many]


def test_long_texts_are_read_in_lanes():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(60)]
    text = " ".join(rng.choice(words, 900))
    profiles = {"x": " ".join(rng.choice(words, 50)), "y": " ".join(words[:20])}
    lang, score, bits, letters = li.Identifier(profiles).predict(["", text, None, text[:700]])[1]
    assert (lang, pytest.approx(score)) == brute_force(profiles, text)
    read = letters_only(text)
    assert letters == sum(c != " " for c in read) and len(read) > 2 * li.PIECE
    assert bits == pytest.approx(longest_match_phrases(letters_only(profiles[lang]), read) * math.log2(len(letters_only(profiles[lang]))) / len(read))


def test_letters_may_share_a_place():
    many = "".join(chr(0x4E00 + 7 * i) for i in range(600))
    assert li.Identifier({"zh": many, "la": "abc"}).predict([many, "cab"])[0][0] == "zh"


def test_rows_equal_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    profiles, beyond = li.fit_profiles(li.learnable(docs), profile_chars=2_000, sample_docs=20)
    assert list(profiles) == sorted(profiles) and all(len(p) <= 2_000 for p in profiles.values()) and beyond
    found = li.identify(docs, profile_chars=2_000, sample_docs=20).select("doc_id", "text", "identified.*").limit(40).collect()
    for row in found:
        lang, score = brute_force(profiles, row["text"])
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, abs=1e-9)


def test_held_out_accuracy(spark, sf_dir):
    docs = read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    found = li.op1_language_id(docs).join(docs, "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count()
    assert right >= 0.98 * found.count()
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_ties_go_to_the_language_that_sorts_first():
    found = li.Identifier({"aa": "one two three", "bb": "one two three"}).predict(["two", "zzz"])
    assert [f[:2] for f in found] == [("aa", 0.5), ("aa", 0.5)]


def test_odd_rows(odd, empty):
    out = li.op1_language_id(odd)
    rows = {(r["doc_id"]): r for r in out.collect()}
    assert out.count() == 14
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert {rows[i]["lang_pred"] for i in (5, 7, 9, 11)} == {"en"} and rows[10]["lang_pred"] == "de"
    assert li.op1_language_id(empty).count() == 0


def test_one_letter_is_enough(frame):
    docs = frame([(1, "some text"), (2, "m²"), (3, "x² + 1"), (4, "²"), (6, "other text"), (9, "a")])
    assert {r["doc_id"]: r["lang_pred"] for r in li.op1_language_id(docs).collect()} == {1: "en", 2: "en", 3: "en", 4: "und", 6: "en", 9: "en"}


def test_nothing_to_learn_from(frame):
    assert [r["lang_pred"] for r in li.op1_language_id(frame([(1, "some text", None)])).collect()] == ["und"]


def test_stage_keeps_columns_and_rejects_und(odd, empty):
    kept = li.keep_identified(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [5, 5, 6, 7, None, 8, 9, 10, 11]))
    assert li.keep_identified(empty).count() == 0


def test_stage_keeps_texts_where_no_language_is_learned(frame):
    docs = frame([(1, "some text", None), (2, None, None), (3, "12 !?", None), (4, "été", None)])
    assert sorted(r["doc_id"] for r in li.keep_identified(docs).collect()) == [1, 4]


def test_stage_rejects_what_is_in_no_learned_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    other = docs.limit(1).selectExpr("-7L AS doc_id", "repeat('съешь же ещё этих мягких французских булок ', 20) AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    short = other.selectExpr("-8L AS doc_id", "'Привет' AS text", "lang", "source", "n_chars")
    kept = {r["doc_id"] for r in li.keep_identified(docs.unionByName(other).unionByName(short)).select("doc_id").collect()}
    assert -7 not in kept and -8 in kept and len(kept) == docs.where(r"text RLIKE '\\p{L}'").count() + 1
