"""Language identification: known words first, character n-grams for the rest.

A word that training has met scores by its log frequency in each language. Any other word backs off to its character
n-grams, the longest first: where an n-gram of some length is known, it scores; characters that no n-gram of that
length covers are left to the next shorter one, each step costing a constant.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import free_name
from triagelake.llm.parts import Known, cuts, parts_of

#: Runs of letters; words without a letter proper are dropped afterwards.
WORDS = re.compile(r"[^\W\d_]+")
#: The undetermined language: no text, or no letters in it.
UNDETERMINED = "und"
GRAMS = (5, 4, 3, 2, 1)
#: Log cost of a step back to a shorter n-gram, and of a character that none covers.
STEP, UNSEEN = -0.7, -12.0


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, each lowered on its own; runs without a letter proper are none."""
    return [w.lower() for w in WORDS.findall(text) if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Table:
    """Log frequencies of keys by language: a row number for each key and a row of scores."""

    rows: dict[str, int]
    scores: np.ndarray

    def get(self, key: str) -> np.ndarray | None:
        row = self.rows.get(key)
        return None if row is None else self.scores[row]


@dataclass
class Model:
    """Log frequencies by language of words and of n-grams of each length."""

    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def __post_init__(self) -> None:
        self._sums = None

    def __reduce__(self):
        return Model, (self.languages, self.words, self.grams)

    def back_off(self, word: str) -> np.ndarray:
        padded, total, count = f"^{word}$", np.zeros(len(self.languages)), 0
        open_, cost = [True] * len(padded), 0.0
        open_[0] = open_[-1] = False
        for n in GRAMS:
            table, taken = self.grams[n], []
            for i in range(len(padded) - n + 1):
                if any(open_[i : i + n]):
                    scores = table.get(padded[i : i + n])
                    if scores is not None:
                        total += scores + cost
                        count += 1
                        taken.append(i)
            for i in taken:
                open_[i : i + n] = [False] * n
            cost += STEP
            if not any(open_):
                break
        left = sum(open_)
        # A word weighs about as much as a known one, however many n-grams it has.
        return (total + UNSEEN * left) / max(1, (count + left) ** 0.5)

    def score(self, word: str) -> np.ndarray:
        """Log score of a word in each language: as a whole if it is known, else by its n-grams."""
        known = self.words.get(word)
        return self.back_off(word) if known is None else known

    def predict_all(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language of each text (none null) and its share of the likelihood."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self._sums is None:
            self._sums = _Sums(len(self.languages))
        words, total = self._sums.of(texts, self.score)
        likely = np.exp(total - total.max(axis=1, keepdims=True))
        best = likely.argmax(axis=1)
        share = likely[np.arange(len(likely)), best] / likely.sum(axis=1)
        return [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), words.tolist(), strict=True)], np.where(words > 0, share, 0.0).tolist()

    def predict(self, text: str | None) -> tuple[str, float]:
        languages, shares = self.predict_all(pa.array([text or ""], pa.string()))
        return languages[0], shares[0]


class _Rows:
    """Numbers by row, as many in each."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.values = np.zeros((1 << 10, self.width))

    def room(self, rows: int) -> np.ndarray:
        """The values, with as many rows at least."""
        while rows > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        return self.values


class _Sums:
    """Number of words and sum of their scores, for each distinct part of texts."""

    def __init__(self, languages: int):
        self.table = _Rows(1 + languages)
        self.known = Known(self.table)

    def of(self, texts: pa.Array, score: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def add(first: int, parts: list[bytes]) -> None:
            values = self.table.room(first + len(parts))
            for row, part in enumerate(parts, first):
                words = words_of(part.decode())
                values[row, 0] = len(words)
                values[row, 1:] = sum(map(score, words)) if words else 0.0

        parts, before = parts_of(texts)
        numbers = self.known.rows(parts, add)
        rows = self.table.values[numbers]
        sums = np.zeros((len(texts), rows.shape[1]))
        some = np.diff(before) > 0
        if some.any():
            sums[some] = np.add.reduceat(rows, before[:-1][some])
        return sums[:, 0], sums[:, 1:]


def _table(keys: Iterable[tuple[str, int, int]], languages: int, least: int = 0) -> Table:
    """From (key, language number, count); keys that are met fewer than `least` times are left out."""
    rows: dict[str, int] = {}
    flat = np.fromiter((x for key, language, count in keys for x in (rows.setdefault(key, len(rows)), language, count)), np.int64).reshape(-1, 3)
    counts = np.bincount(flat[:, 0] * languages + flat[:, 1], flat[:, 2], len(rows) * languages).reshape(len(rows), languages)
    if least:
        kept = np.flatnonzero(counts.sum(axis=1) >= least)
        new = np.full(len(rows), -1)
        new[kept] = np.arange(len(kept))
        rows, counts = {k: int(new[r]) for k, r in rows.items() if new[r] >= 0}, counts[kept]
    scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(rows) + 1.0))
    return Table(rows, scores.astype(np.float32))


def build(rows: list[tuple[str, str, int]], least: int = 2) -> Model:
    """A model from (language, word, count); words met fewer than `least` times are unseen words, and count for the n-grams only."""
    languages = sorted({r[0] for r in rows})
    number = {language: i for i, language in enumerate(languages)}
    words = _table(((word, number[language], count) for language, word, count in rows), len(languages), least)
    grams = {n: _table(((gram, number[language], count) for language, word, count in rows for gram in grams_of(word, n)), len(languages)) for n in GRAMS}
    return Model(languages, words, grams)


def drawn(labelled: DataFrame, sample: int) -> DataFrame:
    """Of rows (id, lang, text) about `sample` a language, all if it has fewer: those with the smallest hashes of id, text and row number.

    The row number tells rows apart that are equal, or have no id: such rows are drawn one by one, and a language made of them keeps its share. Which rows
    are drawn depends on the table's partitions. The languages and their sizes reach the driver, as the model's languages do.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled
    bound = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, hash_bound(sample, n)))), F.col("lang"))
    own = labelled.withColumn("__row", F.monotonically_increasing_id())
    return own.filter(F.xxhash64("id", "text", "__row", F.lit("language sample")).bitwiseAND(F.lit((1 << 63) - 1)) <= bound).drop("__row")


def hash_bound(sample: int, n: int) -> int:
    """The hash, of 0 to 2^63 - 1, up to which `sample` of n rows stay on average, whatever n is."""
    return min((1 << 63) - 1, (sample << 63) // max(n, 1))


def fit(labelled: DataFrame, *, sample: int = 1000, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """Fits on about `sample` documents of each language, its bound (see drawn); a language with fewer is fitted on all of its documents.

    Rows without a language or text are left out. The word counts of the sample are what reaches the driver.
    """
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[lang].update(words_of(text))
        rows = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counts = drawn(labelled, sample).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # As Arrow, since a Row takes many times the bytes of what is in it.
    found = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return build(list(zip(*(found.column(name).to_pylist() for name in ("lang", "word", "n")), strict=True)))


def held_out(id_col: Column) -> Column:
    """The documents that fitting may not use: CRC-32 of the id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def annotate(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred and score, predicted from its whole text.

    `und` with score 0 where the text is null or has no letter, or where the model has no language. The score is the
    share of the likelihood that the language has. Rows that repeat an id are all answered; an empty table
    gives an empty one; only the text is looked at. Columns named lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    # The text goes to the workers once where it is kept.
    own = text_col if any(f.name == text_col for f in keep) else free_name(docs, "text")
    more = [] if own == text_col else [F.col(text_col).alias(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches, own):
            languages, shares = shared.value.predict_all(pc.fill_null(batch.column(own), ""))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(more) :], pa.array(languages, pa.string()), pa.array(shares, pa.float64())], names=[*(f.name for f in keep), "lang_pred", "score"])

    rows = docs.select(*more, *(f"`{f.name}`" for f in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)
