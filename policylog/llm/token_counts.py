"""Token counts of whole documents without materialising their ids.

A pre-token is a piece of a text that no token reaches out of (see :mod:`policylog.llm.bpe`). Documents are taken in
blocks; each block sums up, per distinct pre-token, which of its documents hold it how often. These postings are dealt
out by a hash of the pre-token, so that all blocks' postings of a pre-token meet: there its pieces are counted once,
multiplied by the frequencies and summed per document. The sums go back to the block's documents.

A pre-token in over 1/64 of a block's documents would have long postings everywhere and make one task hot. Such are few
(at most 64 times the mean number of distinct pre-tokens in a document); the block counts them itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylog.llm.bpe import PieceEncoder
from policylog.llm.common import release_caches, shuffle_partitions

BLOCK_CHARS = 16 << 20
HOT_SHARE = 64
_POSTING = np.dtype([("doc", "<u4"), ("n", "<u4")])
_PARTS = "block long, bucket int, ids binary, sizes binary, tokens binary, postings binary"


def _bucket(piece: str, buckets: int) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % buckets


def _row(block: int, bucket: int, ids: bytes | None, sizes: bytes | None, tokens: bytes | None, postings: bytes | None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((block, bucket, ids, sizes, tokens, postings), kinds)], _PARTS.replace(",", "").split()[::2])


def _postings(path: str, cut: str, buckets: int):
    """Blocks of documents -> for each bucket one row with its pre-tokens and postings, and one row (bucket -1) with the
    documents' ids, sizes and what the hot pre-tokens came to."""

    def close(block: int, ids: list, sizes: list, codes: dict, per_doc: list) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        # Not by number alone: where a repeated attempt deals rows in another order, sums must not meet other documents.
        block = xxh64_intdigest(repr((block, ids, sizes))) >> 1
        encoder = PieceEncoder.get(path, cut)
        n = len(ids)
        lengths = np.array([len(x) for x in per_doc], np.int64)
        flat = (np.concatenate(per_doc) if per_doc else np.array([], np.int64)) * n + np.repeat(np.arange(n), lengths)
        pairs, times = np.unique(flat, return_counts=True)
        code, doc = pairs // n, pairs % n
        held = np.bincount(code, minlength=len(codes))
        pieces = list(codes)
        hot = held > max(16, n // HOT_SHARE)
        value = np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(hot).tolist()
        value[at] = encoder.sizes([pieces[i] for i in at])
        sums = np.bincount(doc, weights=value[code] * times, minlength=n).astype(np.int64)
        packed = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums)], ["doc_id", "n_bytes", "n_tokens"])
        yield _row(block, -1, packed.schema.serialize().to_pybytes(), packed.serialize().to_pybytes(), None, None)
        owner = np.array([_bucket(p, buckets) for p in pieces], np.int64)
        owner[hot] = buckets
        order = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[order], np.arange(buckets + 1))
        begin = np.concatenate(([0], np.cumsum(held)))
        table = np.empty(len(pairs), _POSTING)
        table["doc"], table["n"] = doc, times
        for b in range(buckets):
            own = order[first[b] : first[b + 1]]
            if not len(own):
                continue
            counts = held[own]
            rows = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            tokens = pa.array([pieces[i] for i in own.tolist()], pa.string())
            packed = pa.RecordBatch.from_arrays([tokens, pa.array(counts.astype(np.int32))], ["t", "c"]).serialize().to_pybytes()
            yield _row(block, b, None, None, zlib.compress(packed, 1), zlib.compress(table[rows].tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("pieces")
        part, seq = TaskContext.get().partitionId(), 0
        encoder = PieceEncoder.get(path, cut)
        pieces_of = encoder.pieces

        def fresh():
            codes: dict = defaultdict()
            codes.default_factory = codes.__len__
            return [], [], codes, [], 0

        ids, sizes, codes, per_doc, chars = fresh()
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                if encoder.checked < 5:
                    encoder.encode([text])  # which proves the cuts right for this file
                ids.append(i)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                per_doc.append(np.fromiter(map(codes.__getitem__, pieces_of(text)), np.int64))
                chars += len(text) + 16
                if chars > BLOCK_CHARS:
                    yield from close(part << 32 | seq, ids, sizes, codes, per_doc)
                    seq += 1
                    ids, sizes, codes, per_doc, chars = fresh()
        if ids:
            yield from close(part << 32 | seq, ids, sizes, codes, per_doc)

    return run


def _sums(path: str, cut: str, cache_pieces: int = 400_000):
    """A bucket's postings -> per block the documents that gain tokens, and how many. Document lists pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("pieces")
        encoder, known = PieceEncoder.get(path, cut), {}
        for batch in batches:
            for block, bucket, ids, sizes, tokens, postings in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    yield _row(block, bucket, ids, sizes, None, None)
                    continue
                schema = pa.schema([("t", pa.string()), ("c", pa.int32())])
                packed = pa.ipc.read_record_batch(pa.py_buffer(zlib.decompress(tokens)), schema)
                pieces = packed.column(0).to_pylist()
                if len(known) > cache_pieces:
                    known.clear()
                new = [p for p in pieces if p not in known]
                known.update(zip(new, encoder.sizes(new)))
                value = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
                table = np.frombuffer(zlib.decompress(postings), _POSTING)
                gain = np.bincount(table["doc"], weights=np.repeat(value, packed.column(1).to_numpy()) * table["n"]).astype(np.int64)
                docs = np.flatnonzero(gain)
                yield _row(block, bucket, docs.astype("<u4").tobytes(), gain[docs].astype("<i8").tobytes(), None, None)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by block; each block's document list comes first."""
    now, docs, total = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for block, bucket, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket < 0:
                if now is not None:
                    yield done()
                docs = pa.ipc.read_record_batch(pa.py_buffer(sizes), pa.ipc.read_schema(pa.py_buffer(ids)))
                now, total = block, docs.column(2).to_numpy().copy()
            else:
                assert block == now, "a block's sums came without its documents"
                total[np.frombuffer(ids, "<u4")] += np.frombuffer(sizes, "<i8")
    if now is not None:
        yield done()


def count_tokens(docs: DataFrame, tokenizer_path: str, cut: str = "leading", id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, as the library gives for the whole text with its
    defaults (special strings inside texts become their special ids; none is added).

    A null text counts as empty: 0 and 0. Null ids and repeated rows are kept as they are; an empty table gives no rows;
    other columns are ignored. tokenizer_path must be readable on every executor.
    """
    n = buckets or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    posted = rows.mapInArrow(_postings(tokenizer_path, cut, n), _PARTS)
    place = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("block"))
    summed = posted.repartition(n, place).mapInArrow(_sums(tokenizer_path, cut), _PARTS)
    dealt = summed.select("block", "bucket", "ids", "sizes").repartition(n, "block").sortWithinPartitions("block", "bucket")
    return dealt.mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
