import os
import struct
import tempfile
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import sentencepiece_codec as sc

if not os.path.exists(sc.MODEL):
    pytest.skip("no model file", allow_module_level=True)
sentencepiece = pytest.importorskip("sentencepiece")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
PIECES = sc.Pieces.load(sc.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghin  \n\t=-/.,|é▁²😀"), st.characters(codec="utf-8")), max_size=80))
def test_ids_equal_the_library(text):
    ids = PIECES.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert PIECES.decode(ids) == LIBRARY.decode(ids.tolist())


@pytest.mark.parametrize("text", ["=" * 5000, "abcdefghing" * 500, "a" * 3000, ("the" * 7 + " ") * 200, "\n" * 100])
def test_long_texts_commit_along_the_way(text):
    assert PIECES.encode(text).tolist() == LIBRARY.encode(text)


def best_score(scores, text, least):
    @cache
    def best(n):
        if n == 0:
            return 0.0
        return max(best(i) + scores.get(text[i:n], least if n - i == 1 else float("-inf")) for i in range(n))

    return best(len(text))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=4), st.floats(-9, -1), min_size=1), st.text("abc", max_size=120))
def test_unigram_finds_the_best_split(scores, text):
    model = sc.Pieces(list(scores.items()), list(range(len(scores))), None, 99, unigram=True)
    pieces = list(model.split(text))
    assert "".join(pieces) == text
    assert sum(scores.get(p, model.least) for p in pieces) == pytest.approx(best_score(scores, text, model.least))


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*parts):
    """A protocol buffer message of (field, int, float or bytes)."""
    out = b""
    for field, value in parts:
        if isinstance(value, float):
            out += number(field << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            out += number(field << 3 | 2) + number(len(value)) + value
    return out


def model_file(scores, kind=1, normaliser=((1, b"identity"), (4, 0)), odd=()):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in scores.items()), *odd]
    return message(*[(1, message((1, p.encode()), (2, s), (3, t))) for p, s, t in pieces], (2, message((3, kind))), (3, message(*normaliser)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4).filter(lambda p: "▁" not in p[1:]), st.floats(-9, -1, width=32), min_size=3), st.text("abc ", max_size=60))
def test_unigram_models_are_read_as_such(scores, text):
    raw = model_file(scores)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    with tempfile.NamedTemporaryFile() as file:
        file.write(raw)
        file.flush()
        pieces = sc.Pieces.load(file.name)
    assert pieces.unigram
    found, want = pieces.encode(text).tolist(), library.encode(text)
    score = [sum(library.get_score(i) if i else pieces.least for i in ids) for ids in (found, want)]
    assert found == want or score[0] == pytest.approx(score[1])


@pytest.mark.parametrize("raw", [model_file({"a": -1.0}, kind=4), model_file({"a": -1.0}, normaliser=((4, 1),)), model_file({"a": -1.0}, normaliser=((2, b"x"), (4, 0))), model_file({"a": -1.0}, odd=[("own", 0.0, 4)])])
def test_models_that_are_not_supported_are_refused(raw):
    with pytest.raises(ValueError):
        sc.is_unigram(raw)


def test_decode_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, [], "x"), (3, LIBRARY.encode("some text"), None), (4, [None, -5, 10**6], "x"), (None, [3], "x"), (3, LIBRARY.encode("some text"), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, decoded string")
    out = sc.decode(docs)
    assert out.columns == ["doc_id", "ids", "decoded", "_decoded"]
    found = sorted((str(r["doc_id"]), r["_decoded"]) for r in out.collect() if r["doc_id"] != 1)
    mark = LIBRARY.decode([0])
    assert [r["_decoded"] for r in out.where("doc_id = 1").collect()] == [None]
    assert found[:4] == [("2", ""), ("3", "some text"), ("3", "some text"), ("4", PIECES.decode(np.array([0, 0, 0])))] and mark.strip() in found[3][1]
    assert sc.decode(docs.limit(0)).count() == 0


def test_documents_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sc.op3_sentencepiece(docs)
    assert out.where("NOT round_trip").count() == 0
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[r["doc_id"]]["ids"] == LIBRARY.encode(r["text"]) for r in docs.collect())
    again = sc.decode(out.select("doc_id", "ids")).join(docs, "doc_id")
    assert again.where("decoded <> text").count() == 0


def test_odd_rows(odd, empty):
    out = sc.op3_sentencepiece(odd).collect()
    assert len(out) == 14
    rows = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert (rows[1]["n_tokens"], rows[1]["ids"], rows[1]["round_trip"]) == (0, None, None)
    assert (rows[2]["n_tokens"], rows[2]["ids"], rows[2]["round_trip"]) == (0, [], True)
    assert rows[8]["ids"] == LIBRARY.encode("x" * 60_000)
    assert sc.op3_sentencepiece(empty).count() == 0
    coded = sc.encode(odd, check=True)
    assert coded.columns == [*odd.columns, "_ids", "_round_trip"]


def test_without_byte_pieces():
    model = sc.Pieces([("a", -1.0), ("▁", -2.0)], [1, 2], None, 0)
    assert model.encode("ab").tolist() == [2, 1, 0]
    assert model.decode(np.array([2, 1])) == "a"
