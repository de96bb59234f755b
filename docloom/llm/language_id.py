"""Language identification by cross-parsing entropy.

A suffix automaton is built over running labelled text of each language. A text is parsed, across words, into
the longest phrases that the automaton of a language holds; the language that needs the fewest phrases,
each weighed by the log of the size of its training text, wins.

Texts are read as lower-case letters; every run of other characters is one blank, and one blank stands before
the first and after the last letter. The automata are tables of transitions, through which the texts of a batch are
driven side by side, ``PIECE`` characters of a text in a lane: a phrase also ends at the end of its lane.

Defined cases: null text or a text without a letter gives ``und`` with score 0; an empty training table
learns no language, and every text is ``und``; ties go to the language that sorts first; repeated rows are
scored one by one; a null id is neither trained on nor held out; other columns are never read. Letters that
no training text holds are a phrase each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import content_key, free_name, id_bucket

UNDETERMINED = "und"
#: Characters of a lane, characters driven through the tables at once, letters that a language's tables tell apart.
PIECE, AT_ONCE, ALPHABET = 512, 2_000_000, 255
#: A text of so many letters is in none of the languages if it needs so many times the bits a character of any labelled text outside the automata.
JUDGED, REJECT = 200, 1.5
RESULT = "lang_pred string, score double, bits double, letters bigint"

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def read(text: str) -> np.ndarray:
    """The lower-case letters of ``text`` as code points, 0 for the blanks between words and at the ends; empty without a letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[raw]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    if not kept.any():
        return np.zeros(0, np.uint32)
    words = np.where(letter, raw, 0)[kept]
    return np.concatenate([[0], words, [0] if words[-1] else []]).astype(np.uint32)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``text``; state 0 is the empty match."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, at = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                clone = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return moves


def sampled_texts(docs: DataFrame, text: str, lang: str, id_col: str, sample_docs: int, doc_chars: int) -> DataFrame:
    """(lang, dealt, id, text): the first ``doc_chars`` characters of the ``sample_docs`` documents of each language whose id hashes lowest."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL").withColumn("dealt", F.xxhash64("id"))
    # All but about four times the sample goes by a bound on the hash, so ranking sees few rows however large the table is.
    shares = {r["lang"]: min(1.0, 4 * sample_docs / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    bounds = [F.when(F.col("lang") == k, F.lit(int(-(2**63) + share * (2**64 - 1)))) for k, share in shares.items() if share < 1]
    near = labelled.where(F.col("dealt") <= F.coalesce(*bounds, F.lit(2**63 - 1))) if bounds else labelled
    rank = Window.partitionBy("lang").orderBy("dealt", "id")
    chosen = near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample_docs)
    ids = sorted({r[0] for r in chosen.select("id").collect()})
    texts = docs.where(F.col(id_col).isin(ids)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return texts.select(F.col(lang).alias("lang"), F.xxhash64(F.col(id_col)).alias("dealt"), F.col(id_col).alias("id"), F.substring(F.col(text), 1, doc_chars).alias("text"))


def fit_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_docs: int = 300, doc_chars: int = 2_000, profile_chars: int = 30_000
) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Per language the text its automaton is built from, and the sampled texts beyond it.

    The classifier is fitted on a bounded sample: the first ``doc_chars`` characters of the ``sample_docs`` documents
    of each language whose id hashes lowest, one after the other until ``profile_chars``. Callers filter ``docs`` to
    the rows that may be learnt from.
    """
    rows = sampled_texts(docs, text, lang, id_col, sample_docs, doc_chars).collect()
    profiles: dict[str, str] = {}
    beyond: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["dealt"], str(r["id"]), r["text"])):
        known = profiles.get(row["lang"], "")
        if len(known) < profile_chars:
            profiles[row["lang"]] = f"{known} {row['text']}"[:profile_chars]
        else:
            beyond.setdefault(row["lang"], []).append(row["text"])
    return {k: v for k, v in profiles.items() if read(v).size}, beyond


class Identifier:
    """Scores whole texts against the profiles of ``fit_profiles``."""

    def __init__(self, profiles: dict[str, str]):
        texts = [read(t) for t in profiles.values()]
        self.langs = list(profiles)
        self.bits = np.log2([max(2, len(t)) for t in texts])
        #: Place of every code point in the rows of each language's table: 0 for the blank, the last one for letters it does not have.
        self.place = np.zeros((len(texts), 0x110000), np.uint16)
        self.widths, automata = [], []
        for place, text in zip(self.place, texts, strict=True):
            letters = np.unique(text[text > 0])
            self.widths.append(min(len(letters), ALPHABET) + 2)
            place[:] = self.widths[-1] - 1
            place[letters] = 1 + np.arange(len(letters)) % ALPHABET
            place[0] = 0
            automata.append(suffix_automaton(place[text].tolist()))
        #: Where the row of each language's empty match begins, and all rows; an entry is where the next row begins, 0 if there is none.
        starts = np.cumsum([1, *(len(m) * w for m, w in zip(automata, self.widths, strict=True))])
        self.roots = starts[:-1].astype(np.int64)
        self.table = np.zeros(int(starts[-1]), np.int32)
        for root, width, moves in zip(self.roots.tolist(), self.widths, automata, strict=True):
            size = np.fromiter(map(len, moves), np.int64, len(moves))
            places = np.fromiter((c for m in moves for c in m), np.int64, int(size.sum()))
            after = np.fromiter((s for m in moves for s in m.values()), np.int64, int(size.sum()))
            self.table[root + np.repeat(np.arange(len(moves)), size) * width + places] = root + after * width

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many longest matches, one after the other, cover each of the read texts in each language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.any():
            return out
        flat = np.concatenate(texts)
        lanes = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE
        length = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        roots = self.roots[:, None]
        state = np.repeat(roots, len(owner), axis=1).astype(np.int32)
        count = np.zeros(state.shape, np.int32)
        open_lanes = np.searchsorted(-length, -np.arange(PIECE), "left")
        for t in range(int(length[0])):
            k = open_lanes[t]
            c = self.place.take(flat[start[:k] + t], axis=1)
            here = state[:, :k]
            after = self.table.take(here + c)
            lang, lane = np.nonzero(after == 0)
            root = self.roots[lang]
            again = self.table[root + c[lang, lane]]
            count[lang, lane] += (here[lang, lane] != root).astype(np.int32) + (again == 0)
            after[lang, lane] = np.where(again == 0, root, again)
            state[:, :k] = after
        count += state != roots
        np.add.at(out, owner, count.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int]]:
        """Language, score, bits a character in that language and letters of each text."""
        out: list[tuple[str, float, float | None, int]] = [(UNDETERMINED, 0.0, None, 0)] * len(texts)
        places, held, size = [], [], 0
        for k, text in enumerate(texts):
            letters = read(text) if text and self.langs else ()
            if len(letters):
                places.append(k)
                held.append(letters)
                size += len(letters)
            if held and (size >= AT_ONCE or k == len(texts) - 1):
                cost = self.phrases(held) * self.bits
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(cost)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
                for i, lang, s, bits, letters in zip(places, best.tolist(), score.tolist(), least.tolist(), held, strict=True):
                    out[i] = (self.langs[lang], s, bits / len(letters), int(np.count_nonzero(letters)))
                places, held, size = [], [], 0
        return out


_built: dict[str, Identifier] = {}


def language(profiles: dict[str, str], text: Column, df: DataFrame) -> Column:
    """A struct column (lang_pred, score, bits, letters) for ``text``; the profiles, of bounded size, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    key = content_key(profiles)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _built.get(key)
        if model is None:
            _built.clear()
            model = _built[key] = Identifier(shared.value)
        for texts in batches:
            yield pd.DataFrame(model.predict([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "bits", "letters"])

    return predict(text)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(id_bucket(id_col, 3) != 1)


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", **bounds: int) -> DataFrame:
    """``docs`` with a last column of its own, a struct of prediction, score, bits a character and letters."""
    profiles, _ = fit_profiles(learnable(docs, id_col), text, lang, id_col, **bounds)
    return docs.withColumn(free_name(docs, "identified"), language(profiles, F.col(text), docs))


def most_bits(profiles: dict[str, str], beyond: dict[str, list[str]]) -> float:
    """The bits a character beyond which a text is in none of the languages, from the sampled texts outside the automata."""
    found = Identifier(profiles).predict([t for texts in beyond.values() for t in texts])
    return max((bits * REJECT for _, _, bits, letters in found if letters >= JUDGED), default=float("inf"))


def keep_identified(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages.

    A text without a letter goes, and so does one of at least ``JUDGED`` letters that even its best language parses into
    more bits a character than ``REJECT`` times the most that any sampled labelled text outside the automata needs: it
    is in none of the languages. Shorter texts stay. Where no language can be learned, every text with a letter stays;
    where the sample has no text outside the automata, nothing is rejected by its bits.
    """
    profiles, beyond = fit_profiles(learnable(docs, id_col), text, lang, id_col, **bounds)
    if not profiles:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    found = docs.withColumn(name := free_name(docs, "identified"), language(profiles, F.col(text), docs))
    fits = (F.col(name)["letters"] < JUDGED) | (F.col(name)["bits"] <= F.lit(most_bits(profiles, beyond)))
    return found.where((F.col(name)["lang_pred"] != UNDETERMINED) & fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``."""
    found = identify(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "identified.lang_pred", "identified.score")
