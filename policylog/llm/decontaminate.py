"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF (a word counts by the square root of its idf, so that a shared
word adds its idf to the product of two texts), with document frequencies counted over the whole corpus in one scan. Passages
are taken in blocks; a distributed randomised SVD of a block gives its latent space, with as many dimensions as every passage
needs to keep KEPT of its squared length. Overlapping windows of all documents are projected into it, and those whose cosine
with a passage reaches a bound are its candidates. Windows that hold too few of a passage's words for the longest common
subsequence (LCS) to be long enough are told by one product of two small matrices and not projected, which loses nothing. Candidates are settled word by word: the LCS must cover most of the passage, and where it leaves room for a
paraphrase the answer must be there too.

The exact way for the rest: for a passage whose words are in so many documents that they weigh next to nothing, or that the
space does not hold, all windows that hold enough of its words are candidates.

The benchmark is the query set: PASS passages at a time are searched in all documents in one scan.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.llm.common import release_caches, settle

#: Words of a passage and of a document window, and the steps between windows.
PASSAGE, WINDOW, STEP = 48, 64, 16
#: Passages of one latent space, passages searched in one scan, and further dimensions of the random sketch.
BLOCK, PASS, EXTRA = 256, 4_096, 16
#: The share of its squared length that each passage keeps in the latent space.
KEPT = 0.95
#: Cosine from which a window is a candidate for a passage of PASSAGE words; less, by the root of its length, for shorter ones.
COSINE = 0.3
#: Mean idf of its words below which a passage is compared by words.
FAINT = 0.5
#: Words in more than this share of the documents and of the benchmark's items (two at least) can't stand for an answer. A
#: word that is frequent in the documents only because they repeat one passage is not common in this sense.
COMMON = 0.05
#: LCS over passage length: from ALIKE on a passage counts as found, from PARAPHRASE on if its answer is there too.
ALIKE, PARAPHRASE = 0.85, 0.6
_WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, passage int, start long, n_words int, lcs int, similarity double, answered boolean"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def passages_of(words: list[str]) -> list[tuple[int, list[str]]]:
    """(first word, words) of half-overlapping passages; a short tail belongs to the last of them."""
    if len(words) <= PASSAGE:
        return [(0, words)] if words else []
    starts = list(range(0, len(words) - PASSAGE, PASSAGE // 2)) + [len(words) - PASSAGE]
    return [(s, words[s : s + PASSAGE]) for s in starts]


@dataclass
class Passage:
    item: int
    number: int
    words: list[str]
    answer: list[str]


@dataclass
class Block:
    """What a block of passages is searched with. Rows are words of the block."""

    passages: list[Passage]
    #: The row of each word of the index; -1 for others, and at the end.
    rows: np.ndarray
    #: Each row's coordinates, and those of the passages at length 1.
    table: np.ndarray
    queries: np.ndarray
    #: The least cosine of each passage; -1 for those that are compared by words.
    least: np.ndarray
    #: How often each passage (column) holds a row, and the LCS that it needs.
    counted: np.ndarray
    need: np.ndarray
    #: Each passage's words that can stand for its answer.
    content: list[set]


def lcs_length(passage: list[str], region: list[str]) -> int:
    """Longest common subsequence of two word lists, with the passage's positions as bits."""
    masks: dict[str, int] = {}
    for i, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(passage)) - 1
    for w in region:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(passage) - row.bit_count()


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each word, and how many documents there are. docs: one text column."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})  # the benchmark's words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        at, found, held, n = shared.value, np.zeros(len(shared.value), np.int64), Counter(), 0

        def settle_held() -> None:
            for w in at.keys() & held.keys():
                found[at[w]] += held[w]
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                n += 1
                held.update(set(words_of(text.as_py())))
                if len(held) > 300_000:
                    settle_held()
        settle_held()
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(found[hit], n))], ["word", "n"])

    out, n = np.zeros(len(vocabulary), np.int64), 0
    for word, total in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        if word < 0:
            n = total
        else:
            out[word] = total
    return out, n


def latent_space(rows: DataFrame, size: int, rank: int = BLOCK, extra: int = EXTRA, seed: int = 11, parts: int = 8) -> np.ndarray:
    """The first right singular vectors (size x at most rank) of the sparse matrix whose rows are in columns terms
    (array<int>) and weights (array<double>): a randomised range finder with one power step, A'(A omega), whose partial
    products are summed by term, and then the small problem (A q)'(A q). Only size x (rank + extra) numbers and parts
    squares of side rank + extra come to the driver."""
    width = min(rank + extra, size)
    rows = settle(rows.select("terms", "weights").repartition(parts))

    def dense(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t, w in zip(batch.column(0), batch.column(1)):
            yield np.array(t.as_py(), np.int64), np.array(w.as_py())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.default_rng(seed).normal(size=(size, width))
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for terms, weights in dense(batch):
                y = weights @ omega[terms]
                for t, w in zip(terms.tolist(), weights):
                    sums[t] = sums.get(t, 0) + w * y
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["term", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[t] = sums.get(t, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["term", "sums"])

    schema = "term long, sums binary"
    product = np.zeros((size, width))
    for term, sums in rows.mapInArrow(sketch, schema).repartition(parts, "term").mapInArrow(total, schema).collect():
        product[term] = np.frombuffer(sums)
    q, _ = np.linalg.qr(product)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((q.shape[1], q.shape[1]))
        for batch in batches:
            for terms, weights in dense(batch):
                y = weights @ q[terms]
                square += np.outer(y, y)
        yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary())], ["square"])

    square = sum(np.frombuffer(r[0]).reshape(q.shape[1], -1) for r in rows.mapInArrow(project, "square binary").collect())
    values, vectors = np.linalg.eigh(square)
    best = np.argsort(-values)[: min(rank, int((values > values.max() * 1e-9).sum()))]
    return q @ vectors[:, best]


def common_words(items: DataFrame) -> set[str]:
    """Words in over COMMON of the items and in two at least; there are few, as each takes its share of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(text.as_py()))), pa.string())], ["word"])

    least = max(COMMON * items.count(), 1)
    held = items.select("text").mapInArrow(run, "word string").groupBy("word").count()
    return {r.word for r in held.where(F.col("count") > least).collect()}


def _need(n: int) -> float:
    """The LCS that a passage of n words needs."""
    return max(PARAPHRASE * n, min(n, 6))


def make_block(spark: SparkSession, passages: list[Passage], at: dict[str, int], idf: np.ndarray, common: np.ndarray) -> Block:
    """at: the index of each word; idf, common (can't stand for an answer): by index."""
    own = sorted({at[w] for p in passages for w in p.words})
    rows = np.full(len(at) + 1, -1, np.int64)
    rows[own] = np.arange(len(own))
    weight = np.sqrt(idf[own])
    sparse = [np.unique(rows[[at[w] for w in p.words]], return_counts=True) for p in passages]
    matrix = [(terms.tolist(), (counts * weight[terms]).tolist()) for terms, counts in sparse]
    space = latent_space(spark.createDataFrame(matrix, "terms array<int>, weights array<double>"), len(own), len(passages))
    queries = np.stack([np.array(w) @ space[t] for t, w in matrix])
    lengths = np.array([np.dot(w, w) for _, w in matrix])
    held = np.cumsum(queries**2, axis=1) / lengths[:, None]
    enough = np.flatnonzero((held >= np.minimum(KEPT, held[:, -1:] - 1e-9)).all(axis=0))
    rank = int(enough[0]) + 1
    queries, space = queries[:, :rank], space[:, :rank]
    n = np.array([len(p.words) for p in passages])
    faint = (held[:, -1] < KEPT) | (np.array([idf[[at[w] for w in p.words]].mean() for p in passages]) < FAINT)
    least = np.where(faint, -1, COSINE * np.sqrt(n / PASSAGE)).astype(np.float32)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    content = [{w for w in p.words if not common[at[w]]} for p in passages]
    counted = np.zeros((len(own), len(passages)), np.uint8)  # a passage has fewer than 256 words
    for j, (terms, counts) in enumerate(sparse):
        counted[terms, j] = counts
    need = np.array([_need(len(p.words)) for p in passages], np.float32) - 1e-3
    return Block(passages, rows, (weight[:, None] * space).astype(np.float32), queries.astype(np.float32), least, counted, need, content)


def find(words: list[str], at: dict[str, int], blocks: list[Block], any_will_do: bool = False) -> list[tuple]:
    """(item, passage, start, passage words, LCS, cosine, answered) of the best window for each passage that is found."""
    codes = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
    windows = max(len(words) - WINDOW, 0) // STEP + 1 + (len(words) > WINDOW and (len(words) - WINDOW) % STEP > 0)
    out = []
    for block in blocks:
        rows = block.rows[codes]
        places = np.flatnonzero(rows >= 0)
        rows = rows[places]
        best: dict[int, tuple] = {}
        for first in range(0, windows, 256):
            _search(block, best, words, places, rows, first, min(first + 256, windows))
            if best and any_will_do:
                break
        out += [(block.passages[j].item, block.passages[j].number, *hit) for j, hit in best.items()]
        if out and any_will_do:
            break
    return out


def _search(block: Block, best: dict, words: list[str], places: np.ndarray, rows: np.ndarray, first: int, stop: int) -> None:
    """Settles the candidates among the windows first to stop; places: where words of the block are, rows: which."""
    s = np.arange(first, stop) * STEP
    lo, hi = np.searchsorted(places, s - STEP), np.searchsorted(places, s + WINDOW + STEP)  # the region that is settled
    own, local = np.unique(rows[lo[0] : hi[-1]], return_inverse=True)
    if not len(own):
        return
    width = hi - lo
    holds = np.zeros((len(s), len(own)), np.float32)
    holds[np.repeat(np.arange(len(s)), width), local[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - lo + lo[0], width)]] = 1
    found = np.nonzero(holds @ block.counted[own].astype(np.float32) >= block.need)
    last, cosines = -1, None
    for w, j in zip(*(x.tolist() for x in found)):
        start, passage = (first + w) * STEP, block.passages[j]
        if w != last:
            last = w
            a, b = np.searchsorted(places, (start, start + WINDOW))
            latent = block.table[rows[a:b]].sum(axis=0)
            cosines = block.queries @ latent / max(float(np.linalg.norm(latent)), 1e-9)
        if cosines[j] >= block.least[j]:
            _settle(best, words, start, j, float(cosines[j]), passage, block.content[j])


def _settle(best: dict, words: list[str], start: int, j: int, cosine: float, passage: Passage, content: set) -> None:
    region = words[max(0, start - STEP) : start + WINDOW + STEP]
    lcs, n = lcs_length(passage.words, region), len(passage.words)
    if lcs < _need(n):
        return
    present = set(region)
    answered = lcs_length(passage.answer, region) == len(passage.answer) if passage.answer else 2 * len(content & present) >= len(content)
    if not answered and lcs < ALIKE * n:
        return
    if j not in best or (lcs, cosine) > (best[j][2], best[j][3]):
        best[j] = (start, n, lcs, cosine, answered)


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, answer_col: str | None, block: int, group: int) -> Iterator:
    """Broadcasts of (word index, blocks) for group passages each; docs: the column text. Only the words of the benchmark and
    one group's passages are on the driver at once."""
    spark = docs.sparkSession
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer"))
    frequent = common_words(items)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for text in batch.column(0) for w in words_of(text.as_py())}), pa.string())], ["word"])

    vocabulary = [r.word for r in items.select("text").mapInArrow(distinct_words, "word string").distinct().orderBy("word").toLocalIterator()]
    if not vocabulary:
        return
    held, n = document_frequencies(docs, vocabulary)
    every_idf = np.log((2 + n) / (1 + held))
    places = {w: i for i, w in enumerate(vocabulary)}

    def index(passages: list[Passage]):
        own = sorted({w for p in passages for w in p.words})
        at = {w: i for i, w in enumerate(own)}
        taken = [places[w] for w in own]
        common = np.array([held[k] > COMMON * n and w in frequent for k, w in zip(taken, own)])
        made = [make_block(spark, passages[i : i + block], at, every_idf[taken], common) for i in range(0, len(passages), block)]
        return spark.sparkContext.broadcast((at, made))  # at most group passages: about 6 MB for each block of 256

    pending: list[Passage] = []
    for row in items.orderBy("id", "text").toLocalIterator():
        pending += [Passage(row.id, k, words, words_of(row.answer)) for k, (_, words) in enumerate(passages_of(words_of(row.text)))]
        while len(pending) >= group:
            yield index(pending[:group])
            pending = pending[group:]
    if pending:
        yield index(pending)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, block: int = BLOCK, group: int = PASS) -> DataFrame:
    """One row for each passage that a document holds: doc_id, item_id, passage, start (word of the document's window),
    n_words, lcs, similarity (cosine), answered. Documents without a find have no row.

    Passages of fewer than 6 words must match in full. Without an answer column half of the passage's uncommon words count
    as its answer. Null texts and items count as empty and match nothing; an item with a null id is left out, a document
    with one is returned with it; repeated rows give repeated finds; empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_caches()
            names = FOUND.replace(",", "").split()[::2]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            for batch in batches:
                out = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += [(key, *hit) for hit in find(words_of(text.as_py()), *shared.value)]
                columns = zip(*out) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return rows.mapInArrow(run, FOUND)

    found = [searched(x) for x in _indexes(rows.select("text"), benchmark, item_col, item_text_col, answer_col, block, group)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, block: int = BLOCK, group: int = PASS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark. Each row is judged by its own text, so
    null and repeated ids don't matter; nothing is moved between tasks."""

    def kept(df: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_caches()
            for b in batches:
                yield b.filter(pa.array([not find(words_of(x.as_py()), *shared.value, any_will_do=True) for x in b.column(text_col)], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for shared in _indexes(texts, benchmark, item_col, item_text_col, answer_col, block, group):
        docs = kept(docs, shared)
    return docs
