"""Language identification by word-first backoff.

A word that the training rows hold is scored by its log frequency in each language. Any other word falls back to the
longest of its character n-grams that are known: the mean of their log frequencies, five characters first, then four,
down to one. A text's scores are the sums over its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model's bound: about so many rows to learn from. All their words and n-grams are kept.
TRAINING_ROWS = 6_000
LONGEST = 5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    """Lower-cased runs of letters with their counts."""
    found = Counter(_LETTERS.findall((text or "").lower()))
    if not "".join(found).isalpha():  # digits like fractions also count as word characters
        for w in [w for w in found if not w.isalpha()]:
            n = found.pop(w)
            for c in filter(str.isalpha, w):
                found[c] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    padded = f"_{word}_" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """tables[n]: log frequencies by language for each n-gram; n = 0 holds whole words."""

    def __init__(self, languages: list[str], counts: dict[int, dict[str, list[int] | np.ndarray]], smoothing: float = 0.5):
        self.languages = languages
        self.tables: dict[int, dict[str, tuple[float, ...]]] = {}
        for n, grams in counts.items():
            table = np.array(list(grams.values()), float).reshape(len(grams), len(languages)) + smoothing
            self.tables[n] = dict(zip(grams, map(tuple, np.log(table / table.sum(axis=0)).tolist())))

    def vector(self, word: str) -> tuple[float, ...]:
        if (known := self.tables.get(0, {}).get(word)) is not None:
            return known
        for n in range(LONGEST, 0, -1):
            hits = [x for x in map(self.tables.get(n, {}).get, grams_of(word, n)) if x is not None]
            if hits:
                return tuple([sum(column) / len(hits) for column in zip(*hits)])
        return (0.0,) * len(self.languages)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_rows: int = TRAINING_ROWS) -> Model:
    """Counts the rows that hold a word, and the words that hold an n-gram, over a hash sample of about max_rows rows that
    have text and language, on the executors; a word that one row repeats counts once, so no row can swamp the others.
    Only these counts come to the driver, as Arrow batches: their number is bounded by the rows."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = known.count()
    share = int(min(1.0, max_rows / max(total, 1)) * (1 << 20))
    rows = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(Counter)

        def flush():
            flat = [(lang, n, g, c) for (lang, n), grams in found.items() for g, c in grams.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*flat), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "gram", "c"]) if flat else None

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                found[lang, 0].update(words.keys())
                for n in range(1, LONGEST + 1):
                    found[lang, n].update(g for w in words for g in grams_of(w, n))
                if sum(map(len, found.values())) > 1_000_000:
                    yield flush()
        if (last := flush()) is not None:
            yield last

    counted = rows.mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    got = counted.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[int, dict[str, list[int]]] = {n: {} for n in range(LONGEST + 1)}
    for batch in got.sort_by([("n", "ascending"), ("gram", "ascending")]).to_batches(50_000):
        for lang, n, gram, c in zip(*(batch.column(k).to_pylist() for k in ("lang", "n", "gram", "c"))):
            counts[n].setdefault(gram, [0] * len(languages))[at[lang]] += c
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 300_000) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the winner's posterior under equal priors).

    A null text, one without a letter, or a model without languages gives ``und`` and 0. Ties go to the language that
    sorts first. Null ids and repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAINING_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        rows: dict[str, int] = {}
        table = np.empty((1 << 12, len(m.languages)))
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                if not words or not m.languages:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(rows) > cache_words:
                    rows.clear()
                for w in words:
                    if w not in rows:
                        if len(rows) == len(table):
                            table = np.concatenate((table, np.empty_like(table)))
                        table[len(rows)] = m.vector(w)
                        rows[w] = len(rows)
                at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
                sums = np.fromiter(words.values(), float, len(words)) @ table[at]
                chances = np.exp(sums - sums.max())
                preds.append(m.languages[int(sums.argmax())])
                scores.append(float(chances.max() / chances.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
