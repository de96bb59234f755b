import math

import pytest

from docloom.llm import toxicity as t

LEXICON = t.Lexicon({"idiot": 3.0, "trash": 2.0, "stupid": 2.0})


def terms(text):
    folded = t.fold(text)
    return [folded[a:b] for a, b, _ in LEXICON.matches(folded)]


def test_folding_and_boundaries():
    assert terms("You IDIOT, you!") == ["idiot"]
    assert terms("1d10t 1di0t idi​ot іdіоt iiiidiot stup!d $tupid") == ["idiot"] * 5 + ["stupid"] * 2
    assert terms("idiotic nonidiot trashy") == []
    assert terms("put it in the trash can, not the trash") == ["trash"]
    assert t.fold("in 1984 and 3 of 10 left") == "in 1984 and 3 of 10 left"


def test_normalised_by_length():
    short, long = LEXICON.features("an idiot"), LEXICON.features("an idiot " + "word " * 500)
    assert short[0] == long[0] and short[1] > 50 * long[1] > 0
    assert LEXICON.features(None) == LEXICON.features("") == LEXICON.features("fine words") == (0.0, 0.0)


def test_held_out_rows(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{where}/{n}.parquet") for n in ("documents", "labels"))
    out = t.op6_toxicity(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = held[held.toxic == 1].score.values, held[held.toxic == 0].score.values
    area = (toxic[:, None] > clean[None, :]).mean() + 0.5 * (toxic[:, None] == clean[None, :]).mean()
    assert area > 0.93 and (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.01


def brute_force(model, text):
    """The score of a text by the definition: every place of every term, one after the other."""
    weights, exceptions, beta = model
    folded, total = t.fold(text or ""), 0.0

    def places(phrase):
        for at in range(len(folded) - len(phrase) + 1):
            end = at + len(phrase)
            if folded.startswith(phrase, at) and not folded[max(0, at - 1) : at].isalnum() and not folded[end : end + 1].isalnum():
                yield at, end

    excepted = [p for phrase in exceptions for p in places(t.fold(phrase))]
    for term, weight in weights.items():
        if term in folded:
            total += weight * sum(not any(a <= at and end <= b for a, b in excepted) for at, end in places(term))
    z = beta[0] + beta[1] * math.log1p(total) + beta[2] * (100 * total / (1 + len((text or "").split())))
    return total, 1 / (1 + math.exp(-max(-500, min(500, z))))


def test_scores_equal_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{n}.parquet") for n in ("documents", "labels"))
    model = t.fit(docs.where(t.id_bucket("doc_id", 5) != 0), labels.where(t.id_bucket("doc_id", 5) != 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = t.op6_toxicity(docs, labels).collect()
    assert model[0] and len(rows) == len(texts) and any(r["score"] > 0.5 for r in rows)
    for row in rows[:300]:
        assert row["score"] == pytest.approx(brute_force(model, texts[row["doc_id"]])[1])


def test_exceptions_are_learned(spark):
    toxic = [(i, f"you idiot number{i} go away scum{i % 7} idiot") for i in range(60)]
    clean = [(100 + i, f"the village idiot is a figure of tale{i % 11} and fair words") for i in range(24)] + [(200 + i, f"fair words of tale{i % 11} without any of it") for i in range(600)]
    docs = spark.createDataFrame([*toxic, *clean], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id < 100 AS INT) AS toxic")
    weights, exceptions, _ = t.fit(docs, labels)
    assert "idiot" in weights and {"village idiot", "idiot is"} <= set(exceptions) and "you idiot" not in exceptions
    assert t.fit(docs, labels, exceptions=())[1] == exceptions[len(t.EXCEPTIONS) :]
    assert t.Lexicon(weights, exceptions).features("a village idiot")[0] == 0 < t.Lexicon(weights, exceptions).features("an idiot")[0]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 12)] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    out = t.op6_toxicity(odd, labels)
    assert out.count() == 14 and out.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert len({r["score"] for r in out.where("doc_id IN (1, 2)").collect()}) == 1
    none = labels.limit(0)
    assert {(r["score"], r["predicted"]) for r in t.op6_toxicity(odd, none).collect()} == {(0.0, 0)}
    assert t.op6_toxicity(empty, labels).count() == 0


def test_very_many_exceptions_take_linear_time():
    """A text that is one exception over and over: twice the text, about twice the time, not four times."""
    import time

    from docloom.llm.toxicity import Lexicon

    lexicon = Lexicon({"trash": 1.0, "can": 1.0}, ("trash can",))

    def seconds(n):
        began = time.process_time()
        assert lexicon.matches("trash can " * n + "trash") == [(10 * n, 10 * n + 5, 1.0)]
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 3.5 * max(seconds(100_000), 0.02)


def test_terms_that_an_exception_holds_only_in_part(spark):
    from docloom.llm.toxicity import Lexicon

    lexicon = Lexicon({"b c": 1.0, "c": 2.0, "d": 3.0}, ("a b", "a b c", "x"))
    assert lexicon.matches("a b c d") == [(6, 7, 3.0)]
    assert lexicon.matches("x b c") == [(2, 5, 1.0), (4, 5, 2.0)]
