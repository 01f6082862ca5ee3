"""A byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk's byte
embeddings; each filter's largest response in a chunk is kept (max-pooling). The mean and the maximum of these over the
document's chunks go into one logistic unit. Everything is learned together, by gradients that flow back through the
maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylog.llm.common import release_caches

#: The training sample's bound: about so many labelled rows, each with its whole text.
TRAINING_ROWS = 3_000
#: Chunks that are worked on at once.
BLOCK = 512
CHUNK, OVERLAP, STRIDE, WIDTH, EMBED, FILTERS = 256, 32, 2, 8, 6, 24
_STEP = CHUNK - OVERLAP


def chunks_of(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, each OVERLAP bytes into the one before, zero-padded at the end; one row for an empty text."""
    n = max(1, -(-(len(data) - OVERLAP) // _STEP))
    padded = np.zeros((n - 1) * _STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::_STEP]


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Each filter's largest rectified response in each chunk, and if asked for, the window it comes from."""
        embedded = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        count = windows.shape[1]
        responses = (windows.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(chunks), count, FILTERS)
        best = np.maximum(responses.max(axis=1) + self.bias, 0)
        return (best, responses.argmax(axis=1)) if where else best

    def score(self, pooled: np.ndarray) -> float:
        z = np.concatenate((pooled.mean(axis=0), pooled.max(axis=0))) @ self.out + self.base[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score_text(self, text: str | None, block: int = BLOCK) -> float:
        chunks = chunks_of((text or "").encode("utf-8", "surrogatepass"))
        total, most = np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(0, len(chunks), block):
            pooled = self.pooled(chunks[at : at + block])
            total += pooled.sum(axis=0)
            most = np.maximum(most, pooled.max(axis=0))
        z = np.concatenate((total / len(chunks), most)) @ self.out + self.base[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(samples: list[tuple[np.ndarray, int]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Model:
    """samples: (chunks, label 0 or 1) per document; Adam on the logistic loss."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not samples:
        return model
    prior = np.clip(np.mean([y for _, y in samples]), 0.01, 0.99)
    model.base[0] = np.log(prior / (1 - prior))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    step, total = 0, epochs * -(-len(samples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            docs = [samples[i] for i in order[at : at + batch]]
            chunks = np.concatenate([c for c, _ in docs])
            owner = np.repeat(np.arange(len(docs)), [len(c) for c, _ in docs])
            parts = [model.pooled(chunks[i : i + BLOCK], where=True) for i in range(0, len(chunks), BLOCK)]
            pooled, place = (np.concatenate(x) for x in zip(*parts))
            counts = np.bincount(owner)
            starts = np.cumsum(counts) - counts
            mean = np.add.reduceat(pooled, starts) / counts[:, None]
            most = np.maximum.reduceat(pooled, starts)
            z = np.concatenate((mean, most), axis=1) @ model.out + model.base[0]
            error = ((1 / (1 + np.exp(-z)) - np.array([y for _, y in docs])) / len(docs)).astype(np.float32)
            g_out = np.concatenate((mean, most), axis=1).T @ error
            g_pooled = error[owner, None] * model.out[:FILTERS] / counts[owner, None]
            g_pooled += error[owner, None] * model.out[FILTERS:] * (pooled == most[owner])
            g_pooled *= pooled > 0
            g_filters, g_embed = np.zeros_like(model.filters), np.zeros_like(model.embed)
            for i in range(0, len(chunks), BLOCK):
                g, own = g_pooled[i : i + BLOCK], chunks[i : i + BLOCK]
                at_bytes = place[i : i + BLOCK, :, None] * STRIDE + np.arange(WIDTH)
                hit = own[np.arange(len(own))[:, None, None], at_bytes]  # chunk, filter, position
                g_filters += np.einsum("cfpe,cf->pef", model.embed[hit], g).reshape(WIDTH * EMBED, FILTERS)
                back = np.einsum("cf,pef->cfpe", g, model.filters.reshape(WIDTH, EMBED, FILTERS))
                g_embed += np.stack([np.bincount(hit.ravel(), weights=back[..., e].ravel(), minlength=256) for e in range(EMBED)], axis=1)
            step += 1
            now = rate * (1 - step / (total + 1))
            for p, g, (m, v) in zip(model.parameters(), (g_embed, g_filters, g_pooled.sum(axis=0), g_out, error.sum(keepdims=True)), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAINING_ROWS) -> Model:
    """Fits on a hash sample of about max_rows labelled rows, whose whole texts come to the driver.

    Rows without label, id or text are left out; of several labels of one id the largest counts. Without any labelled
    row the model's score is near 0.5 for every text. Of rows that repeat an id the text that sorts first counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    share = int(min(1.0, max_rows / max(known.count(), 1)) * (1 << 20))
    known = F.broadcast(known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share))  # about max_rows rows
    rows = docs.join(known, docs[id_col] == known["_id"]).where(F.col(text_col).isNotNull()).select("_id", "_label", F.col(text_col).cast("string").alias("_text"))

    got = rows.select(F.col("_id").cast("long").alias("_id"), "_label", F.encode("_text", "utf-8").alias("_text")).groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    got.sort(key=lambda r: r["_id"])
    return fit([(chunks_of(bytes(r["_text"])), r["_label"]) for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and score (0 to 1, higher is better).

    A null text counts as empty; empty texts are scored like any other. Null ids and repeated rows are kept; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score_text(x.as_py()) for x in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").withColumn("score", F.lit(0.0)).schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            yield b.filter(pa.array([shared.value.score_text(x.as_py()) >= threshold for x in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
