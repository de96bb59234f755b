"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has an arc for every piece that matches. Walking over the end positions, the best
last piece of each prefix is kept as a backpointer; only positions within the longest piece of the end can
still be a start, so a window of that size is live. Whenever the backpointer paths of all live positions
pass through one boundary, the ids before it are final and are committed, and the window moves on.

For a unigram model the best last piece is the one of the highest total score. For a BPE model it is the
one that byte-pair merging leaves last: a sequence of pieces is what merging gives if and only if merging
leaves each two neighbours as they are, so every prefix has exactly one such last piece. The ids are those
of the public library in both cases. The kind is read from the model file; models of other kinds, with a normaliser, or with
symbols of the user's are refused.

All paths also converge where no piece crosses: before a space that follows other characters, and around
line feeds that no piece contains. Texts are cut there, and segments that repeat are encoded once.

Defined cases: null text gives null ids and an empty text no ids; characters without a piece become their
UTF-8 byte pieces, or one unknown id for a run of them where the model has none; repeated rows are encoded one by one;
other columns are kept. Null ids give a null text and no ids an empty one; a null among ids, and an id that the model does not have, is the unknown mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import content_key, free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARKS = "\n\t.,;:!?|"
#: Segments up to this length are cached, and so many of them; pairs of pieces known to stay apart, or not.
CACHED_LENGTH, CACHED_SEGMENTS, CACHED_PAIRS = 32, 600_000, 1_000_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message; the model file is one."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


def is_unigram(raw: bytes) -> bool:
    """Whether a model file is a unigram model, else BPE; what the codec does not do is refused.

    Fixed field numbers of the file format: trainer (2) with the kind (3; 1 unigram, 2 BPE) and blanks as suffixes (24);
    normaliser (3) with its table (2), a blank put first (3), blanks removed (4), blanks escaped (5); pieces (1) with their type (3; 4 of the user's).
    """
    parts = list(fields(raw))
    trainer, normaliser = ({k: v for number, part in parts if number == n for k, v in fields(part)} for n in (2, 3))
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24):
        raise ValueError("models that normalise texts are not supported")
    if any(number == 1 and dict(fields(part)).get(3) == 4 for number, part in parts):
        raise ValueError("models with symbols of the user's are not supported")
    return trainer.get(3, 1) == 1


class Pieces:
    """A vocabulary with the streaming search over it."""

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int], byte_ids: list[int] | None, unknown: int, unigram: bool = False):
        self.id_of = {p: i for (p, _), i in zip(pieces, ids, strict=True)}
        self.score_of = dict(pieces)
        self.byte_ids, self.unknown, self.unigram = byte_ids, unknown, unigram
        self.longest = max(map(len, self.id_of), default=1)
        self.rows: dict[str | None, dict[str, bool]] = {}
        self.pairs = 0
        self.least = min(self.score_of.values(), default=0.0) - 10.0
        #: A node is its children and the piece that ends there; BPE has no use for pieces that merging cannot give.
        self.root: tuple = ({}, [None])
        for piece in self.id_of:
            if unigram or self.merge(list(piece)) == [piece]:
                node = self.root
                for c in piece:
                    node = node[0].setdefault(c, ({}, [None]))
                node[1][0] = piece
        #: Runs of unknown characters are one id, so a text with such runs is not cut.
        self.segment = None if byte_ids is None else self.segments()
        self.cache: dict[str, bytes] = {}
        table = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        self.text_of = [table.get(i, " ⁇ ".encode() if i == unknown else b"") for i in range(max([*table, unknown]) + 1)]

    def segments(self) -> re.Pattern | None:
        """Where texts may be cut because no piece crosses: before spaces, and between most words and marks."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            return None
        mark = f"[{re.escape(MARKS)}]"
        odd = {c for p in self.id_of for x in re.findall(rf"(?=([^\W_]{mark}|{mark}[^\W_]))", p) for c in x if re.match(r"[^\W_]", c)}
        letter = rf"[^\W_{re.escape(''.join(sorted(odd)))}]"
        return re.compile(rf"{SPACE}*{letter}+(?={mark}|{SPACE}|\Z)|{mark}+(?={letter}|{SPACE}|\Z)|{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read the vocabulary of a model file with the public library."""
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        unigram = is_unigram(raw)
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = range(model.get_piece_size())
        plain = [i for i in n if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(model.is_byte, n)) else None
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in plain], plain, byte_ids, model.unk_id(), unigram)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging: the best-scored neighbours first, the leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score_of.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stay_apart(self, left: str | None, right: str) -> bool:
        """Whether merging leaves the two neighbours as they are; kept in ``rows``."""
        if self.pairs >= CACHED_PAIRS:
            self.rows.clear()
            self.pairs = 0
        known = left is None or self.merge([*left, *right]) == [left, right]
        self.rows.setdefault(left, {})[right] = known
        self.pairs += 1
        return known

    def split(self, text: str) -> Iterator[str]:
        """The pieces of ``text``, handed out as soon as they are final."""
        n, window = len(text), 8 * self.longest
        back: list[str | None] = [None]
        total = [0.0]
        done = 0
        for at in range(n):
            room = min(n - done, at - done + self.longest) + 1 - len(back)
            if room > 0:
                back += [None] * room
                total += [0.0] * room
            self.step(text, at, back, total, done)
            if at + 1 - done >= window:
                agreed = self.agreed(back, at + 1 - done)
                if agreed:
                    yield from self.path(back, agreed)
                    done += agreed
                    del back[:agreed], total[:agreed]
        yield from self.path(back, n - done)

    def step(self, text: str, at: int, back: list[str | None], total: list[float], done: int) -> None:
        """Extend the paths that end at ``at`` by every piece that starts there."""
        here, last = at - done, back[at - done]
        row = self.rows.get(last)
        if row is None:
            row = self.rows[last] = {}
        node, past = self.root, at
        n = min(len(text), at + self.longest)
        while past < n:
            node = node[0].get(text[past])
            if node is None:
                break
            past += 1
            piece = node[1][0]
            if piece is not None:
                end = past - done
                if self.unigram:
                    score = total[here] + self.score_of[piece]
                    if back[end] is None or score > total[end]:
                        total[end], back[end] = score, piece
                elif back[end] is None:
                    known = row.get(piece)
                    if known or known is None and self.stay_apart(last, piece):
                        back[end] = piece
        c = text[at]
        if c not in self.id_of:
            score = total[here] + self.least
            free = back[here + 1] is None
            if (free or score > total[here + 1]) if self.unigram else free and self.stay_apart(last, c):
                total[here + 1], back[here + 1] = score, c

    def agreed(self, back: list[str | None], at: int) -> int:
        """The last boundary that the paths of all live ends share: those from ``at`` on."""
        shared: set[int] | None = None
        for live in range(at, len(back)):
            if back[live] is not None:
                path, k = {live}, live
                while k > 0:
                    k -= len(back[k])
                    path.add(k)
                shared = path if shared is None else shared & path
        return max((k for k in shared or () if k <= at), default=0)

    @staticmethod
    def path(back: list[str | None], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(back[end])
            end -= len(back[end])
        return out[::-1]

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(segment):
            known = self.id_of.get(piece)
            if known is not None:
                out.append(known)
            elif self.byte_ids is None:
                if out[-1:] != [self.unknown]:
                    out.append(self.unknown)
            else:
                out += [self.byte_ids[b] for b in piece.encode()]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        if self.segment is None:
            return np.array(self.ids(marked), np.int32)
        cache, parts = self.cache, []
        if len(cache) > CACHED_SEGMENTS:
            cache.clear()
        for segment in self.segment.findall(marked):
            known = cache.get(segment)
            if known is None:
                known = np.array(self.ids(segment), np.int32).tobytes()
                if len(segment) <= CACHED_LENGTH:
                    cache[segment] = known
            parts.append(known)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        ids = np.where((ids < 0) | (ids >= len(self.text_of)), self.unknown, ids)
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def vocabulary(df: DataFrame, path: str) -> tuple:
    """The bounded table of pieces, read where the model file is: on the driver."""
    p = Pieces.load(path)
    return tuple((k, p.score_of[k], i) for k, i in p.id_of.items()), tuple(p.byte_ids or ()), p.unknown, p.unigram


def built(shared: tuple, key: str) -> Pieces:
    """The codec of a table of ``vocabulary``, which a worker keeps."""
    if key not in _loaded:
        rows, byte_ids, unknown, unigram = shared
        _loaded.clear()
        _loaded[key] = Pieces([r[:2] for r in rows], [r[2] for r in rows], list(byte_ids) or None, unknown, unigram)
    return _loaded[key]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with the columns ids and, with ``check``, whether decoding them gives the text back."""
    rows = vocabulary(docs, model)
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), content_key(rows)
    ids, same = free_name(docs, "ids"), free_name(docs, "round_trip")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(same, T.BooleanType())] if check else []))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(shared.value, key)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = [None if t is None else codec.encode(t) for t in texts]
                sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([x is None for x in found] + [False]))
                values = pa.array(np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)]))
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, values)]
                if check:
                    columns.append(pa.array([None if t is None else codec.decode(x) == t for t, x in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(coded, schema)


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with a last column of its own, the text of ``ids``; null where they are null."""
    rows = vocabulary(docs, model)
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), content_key(rows)
    name = free_name(docs, "decoded")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(shared.value, key)
        for batch in batches:
            found = [None if x is None else codec.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(texts, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def op3_sentencepiece(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row of ``documents``."""
    coded = encode(docs.select("doc_id", "text"), model, check=True)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "round_trip")
