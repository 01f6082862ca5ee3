"""A store of token ids: raw id payloads with a minimal perfect hash index per shard.

Layout, under one folder that driver and executors share:

* ``shard-PPPPP-*.ids``: the ids of the shard's documents in ascending id order, back to back, as little-endian
  unsigned integers of 2 bytes (4 if the vocabulary needs them). Nothing else.
* ``shard-PPPPP-*.idx``: a header and arrays (see ``_HEADER``): token offsets into the payload, and a minimal perfect hash
  over the distinct ids: displacements per bucket, and per slot the rank of the first document with this id, how many there
  are, and a 32-bit fingerprint of the id. The ids themselves are not stored: the hash is the only way from an id to its
  document, and the fingerprint tells absent ids apart (but for one in 2^32).
* ``manifest.json``: the shards in order, each with its file names, first and last id and counts.

A lookup takes one binary search over the manifest's id ranges, two hashes, one slot and one read of the payload. Reading
everything back is the same lookup, vectorised, for all ids of a table.
Files carry the task attempt in their names and only those of finished tasks get into the manifest, so lost executors
and repeated tasks can't mix.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.llm.bpe import PieceEncoder, batches_of
from policylog.llm.common import release_caches, shared_dir, shuffle_partitions

MAGIC = b"TOKSTORE1\n"
#: width of an id, seed, nulls in front, documents, distinct ids, buckets
_HEADER = struct.Struct("<HHQQQQ")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LISTING = "part long, ids_file string, idx_file string, n_docs long, nulls long, n_tokens long, first long, last long"
#: Text that a shard holds at most, on average; there are more of them where the cluster has more tasks.
SHARD_BYTES = 256 << 20


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match(r"\w+:", uri):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pa.fs.LocalFileSystem(), uri


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys by hash and displace: a key's slot is a second hash of the key and of
    its bucket's displacement; buckets of one key hold the negated slot instead."""

    def __init__(self, seed: int, n: int, displacement: np.ndarray):
        self.seed, self.n, self.displacement = seed, n, displacement

    @classmethod
    def build(cls, keys: np.ndarray, tries: int = 256) -> PerfectHash:
        """Large buckets first; for each the first displacement that puts its keys onto free slots, many tried at once."""
        n, buckets = len(keys), max(1, (len(keys) + 3) // 4)
        for seed in range(64):
            bucket, own = cls._bucket(keys, seed, buckets), _hash(keys, 2 * seed + 1)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            sizes = np.diff(starts)
            taken, shift = np.zeros(n, bool), np.zeros(buckets, np.int64)
            for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
                hashes = own[order[starts[b] : starts[b + 1]]]
                for first in range(0, 4096 * tries, tries):
                    slots = cls._slot(hashes[None, :], np.arange(first, first + tries)[:, None], n)
                    good = ~taken[slots].any(axis=1)
                    good[good] = (np.diff(np.sort(slots[good], axis=1), axis=1) > 0).all(axis=1)
                    if good.any():
                        shift[b] = first + int(good.argmax())
                        taken[slots[good.argmax()]] = True
                        break
                else:
                    break
            else:
                shift[np.flatnonzero(sizes == 1)] = -np.flatnonzero(~taken) - 1
                return cls(seed, n, shift)
        raise ValueError("no perfect hash found: are the keys distinct?")

    @staticmethod
    def _bucket(keys: np.ndarray, seed: int, buckets: int) -> np.ndarray:
        return (_hash(keys, 2 * seed) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def _slot(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        return (_hash(hashes ^ (displacement.astype(np.uint64) * _MIX2), 7) % np.uint64(max(n, 1))).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[self._bucket(keys, self.seed, len(self.displacement))]
        return np.where(d < 0, -d - 1, self._slot(_hash(keys, 2 * self.seed + 1), d, self.n))


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def index_bytes(width: int, nulls: int, keys: np.ndarray, offsets: np.ndarray) -> bytes:
    """keys: ids in ascending order, the nulls in front as 0; offsets: one more than keys, in tokens."""
    distinct, rank, many = np.unique(keys[nulls:], return_index=True, return_counts=True)
    made = PerfectHash.build(distinct)
    slots = made.slots(distinct)
    ranks, times, prints = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint32)
    ranks[slots], times[slots], prints[slots] = rank + nulls, many, key_prints(distinct)
    head = _HEADER.pack(width, made.seed, nulls, len(keys), len(distinct), len(made.displacement))
    return MAGIC + head + b"".join(x.tobytes() for x in (offsets.astype("<i8"), made.displacement.astype("<i8"), ranks.astype("<i8"), times.astype("<i8"), prints.astype("<u4")))


class ShardIndex:
    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token store index")
        self.width, seed, self.nulls, n, distinct, buckets = _HEADER.unpack_from(data, len(MAGIC))
        at = len(MAGIC) + _HEADER.size
        parts = []
        for kind, size in (("<i8", n + 1), ("<i8", buckets), ("<i8", distinct), ("<i8", distinct), ("<u4", distinct)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        self.offsets, shift, self.ranks, self.times, self.prints = parts
        self.hash = PerfectHash(seed, distinct, shift)
        self.dtype = np.dtype(f"<u{self.width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the rank of its first document and how many it has, 0 if it is absent; constant time a key."""
        if not self.hash.n or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slots = self.hash.slots(keys)
        return self.ranks[slots], np.where(self.prints[slots] == key_prints(keys), self.times[slots], 0)


def _writer(folder: str, path: str, cut: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("pieces")
        encoder, (fs, base) = PieceEncoder.get(path, cut), file_system(folder)
        width = max(encoder.width, 2 if end_id < 1 << 16 else 4)
        dtype = np.dtype(f"<u{width}")
        end = np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"shard-{part:05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        keys, lengths, out = [], [], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in batches_of(batch.column(1)):
                out = out or fs.open_output_stream(f"{base}/{name}.ids")
                for i, made in enumerate(encoder.encode(texts)):
                    made = made if width == encoder.width else np.frombuffer(made, encoder.dtype).astype(dtype).tobytes()
                    out.write(made + end)
                    keys.append(ids[start + i])
                    lengths.append(len(made) // width + 1)
        if out is None:
            return
        out.close()
        nulls = sum(k is None for k in keys)
        order = np.array([k or 0 for k in keys], np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
        with fs.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(index_bytes(width, nulls, order, offsets))
        ends = [int(order[nulls]), int(order[-1])] if nulls < len(keys) else [None, None]
        yield pa.RecordBatch.from_pylist([dict(zip(_LISTING.replace(",", "").split()[::2], (part, f"{name}.ids", f"{name}.idx", len(keys), nulls, int(offsets[-1]), *ends)))], pa.schema([(k, pa.string() if "file" in k else pa.int64()) for k in _LISTING.replace(",", "").split()[::2]]))

    return run


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None, cut: str = "leading", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Encodes all texts, appends end_id to each, writes the store in ascending id order and returns its folder.

    A null text counts as empty (one id). Null ids come first and can't be looked up; rows that repeat an id keep the
    order of their text hashes and are all found by it. An empty table gives a store without shards. Other columns are
    ignored. Only the shards' listing (a row per shard) comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    shards = shards or max(shuffle_partitions(spark), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(_writer(folder, tokenizer_path, cut, end_id), _LISTING)
    listing = sorted((r.asDict() for r in written.collect()), key=lambda r: r["part"])
    start = 0
    for shard in listing:
        shard["start"] = start
        start += shard["n_tokens"]
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"format": MAGIC.decode().strip(), "tokens": start, "shards": listing}).encode())
    return folder


def _manifest(folder: str) -> dict:
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _read(fs: pa.fs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def read_store(keys: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Looks up the ids of keys and reads their documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), and the ids themselves if asked for.

    An id that keys repeats is looked up once and gives all documents that have it; a null id gives all that have none. An
    id that the store doesn't hold is an error. Ids meet the shards in whose range they are, and each shard's index answers
    for all of them at once. Only the manifest's ranges (three numbers a shard) are shipped.
    """
    spark = keys.sparkSession
    shards = _manifest(folder)["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    ranged = [k for k, s in enumerate(shards) if s["first"] is not None]
    firsts, lasts = (np.array([shards[k][end] for k in ranged], np.int64) for end in ("first", "last"))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            lo, hi = np.searchsorted(lasts, ids), np.searchsorted(firsts, ids, side="right")
            if (hi <= lo).any():
                raise KeyError(f"id {ids[hi <= lo][0]} is not in the store")
            width = hi - lo
            at = np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ranged, np.int64)[at]), pa.array(np.repeat(ids, width))], ["shard", "key"])
            if batch.column(0).null_count:
                empty = [k for k, s in enumerate(shards) if s["nulls"]]
                yield pa.RecordBatch.from_arrays([pa.array(empty, pa.int64()), pa.nulls(len(empty), pa.int64())], ["shard", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for shard, asked in _by_shard(batches):
            stated = shards[shard]
            index = ShardIndex(_read(fs, f"{base}/{stated['idx_file']}"))
            ids = np.unique(asked.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            first, times = index.find(ids)
            if (times == 0).any():
                raise KeyError(f"id {ids[times == 0][0]} is not in the store")
            rank = np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            owner, null = np.repeat(ids, times), np.zeros(len(rank), bool)
            if asked.null_count:
                rank, owner, null = (np.concatenate(x) for x in ((np.arange(index.nulls), rank), (np.zeros(index.nulls, np.int64), owner), (np.ones(index.nulls, bool), null)))
            order = np.argsort(rank, kind="stable")
            with fs.open_input_file(f"{base}/{stated['ids_file']}") as payload:
                for part in _runs(rank[order], index.offsets):
                    own = order[part]
                    begin, end = index.offsets[rank[own]], index.offsets[rank[own] + 1]
                    at = int(begin[0])
                    block = np.frombuffer(payload.read_at(int(end[-1] - at) * index.width, at * index.width), index.dtype).astype("<u4")
                    texts = [block[a - at : b - at] for a, b in zip(begin, end)]
                    cols = [pa.array(owner[own], mask=null[own]), pa.array(begin + stated["start"]), pa.array(end - begin), pa.array([zlib.crc32(x.tobytes()) for x in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([x.tolist() for x in texts], pa.list_(pa.int64()))] * with_ids, names)

    asked = keys.select(F.col(id_col).cast("long").alias("key")).mapInArrow(to_shards, "shard long, key long")
    return asked.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """The keys of each shard; rows are sorted by shard."""
    now, held = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and shard[a] != now:
                if held:
                    yield now, pa.concat_arrays(held)
                now, held = int(shard[a]), []
            held.append(batch.column(1).slice(a, b - a))
    if held and now is not None:
        yield now, pa.concat_arrays(held)


def _runs(ranks: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Runs of neighbouring ranks with about most tokens (one document at least)."""
    at = 0
    while at < len(ranks):
        stop = at + 1
        while stop < len(ranks) and ranks[stop] == ranks[stop - 1] + 1 and offsets[ranks[stop] + 1] - offsets[ranks[at]] <= most:
            stop += 1
        yield slice(at, stop)
        at = stop


def remove_store(folder: str) -> None:
    fs, base = file_system(folder)
    fs.delete_dir(base)


class TokenStore:
    """Keyed access from one process; keeps the manifest and the indexes that it has used."""

    def __init__(self, folder: str):
        self.fs, self.base = file_system(folder)
        self.shards = [s for s in _manifest(folder)["shards"] if s["first"] is not None]
        self.lasts = np.array([s["last"] for s in self.shards], np.int64)
        self.indexes: dict[int, ShardIndex] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The id arrays of all documents with this id, end id included; none for an absent id."""
        out, at = [], int(np.searchsorted(self.lasts, key))
        while at < len(self.shards) and self.shards[at]["first"] <= key:
            if at not in self.indexes:
                self.indexes[at] = ShardIndex(_read(self.fs, f"{self.base}/{self.shards[at]['idx_file']}"))
            index = self.indexes[at]
            (first,), (times,) = index.find(np.array([key], np.int64))
            for rank in range(first, first + times):
                with self.fs.open_input_file(f"{self.base}/{self.shards[at]['ids_file']}") as f:
                    data = f.read_at(int(index.offsets[rank + 1] - index.offsets[rank]) * index.width, int(index.offsets[rank]) * index.width)
                out.append(np.frombuffer(data, index.dtype))
            at += 1
        return out
