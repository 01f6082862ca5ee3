"""Packing documents into fixed windows by non-negative least squares over length patterns.

A document's tokens are cut into full windows and a rest. Rests are binned by length; the histogram of bins has a fixed
size whatever the corpus. Rests of at most BINS tokens have a bin for each length: they are first packed, in the same way,
into bundles of BINS tokens, and a bundle is then packed like a rest. Patterns are all combinations of up to three bins that fill a window exactly. Non-negative
least squares finds how often to repeat each pattern so that together they use up the histogram; the counts are rounded
down and what remains is packed greedily, largest first, again on counts only. Where whole rests would leave a gap they are
cut into parts of 2^k bins, which always fit together. The plan is then carried out in a distributed way: rests are numbered
within their bin and look up their sequence by that number.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylog.llm.bpe import PieceEncoder, batches_of
from policylog.llm.common import release_caches, settle, shuffle_partitions

WINDOW = 4096
BINS = 512
#: Bins that a greedily packed sequence of whole rests may leave empty.
GAP = 2


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, cut: str = "dropped", end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, digests: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit) per piece: full windows and the rest of each
    document's ids with end_id behind them. With digests the CRC-32 of the ids (ids_crc32) and of each part that the piece may
    be cut into (part_crc32) take the place of ids. A null text counts as empty and gives one piece with the end id."""
    schema = "doc_id long, start long, length long, doc_tokens long, " + ("ids_crc32 long, part_crc32 array<long>" if digests else "ids binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + ([pa.int64(), pa.list_(pa.int64())] if digests else [pa.binary()])

    def told(ids: bytes, n: int) -> tuple:
        if not digests:
            return (ids,)
        return zlib.crc32(ids), [zlib.crc32(ids[4 * s : 4 * (s + k)]) for s, k in parts_of(n, window, bins)] if n < window else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("pieces")
        encoder = PieceEncoder.get(tokenizer_path, cut)
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in batches_of(batch.column(1)):
                rows = []
                for i, made in enumerate(encoder.encode(texts)):
                    ids = np.concatenate((np.frombuffer(made, encoder.dtype).astype("<u4"), end))
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        rows.append((keys[first + i], start, len(part), len(ids), *told(part.tobytes(), len(part))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


@functools.cache
def patterns(bins: int = BINS) -> np.ndarray:
    """All combinations of one to three bins (1 to bins) that fill a window exactly; padded with 0."""
    found = [(bins, 0, 0), *((bins - b, b, 0) for b in range(1, bins // 2 + 1))]
    for c in range(1, bins // 3 + 1):
        found += [(bins - b - c, b, c) for b in range(c, (bins - c) // 2 + 1)]
    return np.array(found, np.int64)


def nnls(shapes: np.ndarray, histogram: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, where column j of A counts the bins in shapes[j]; by accelerated
    projected gradients. Bin 0 is padding and counts for nothing."""
    n = len(histogram)
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale

    def apply(x):
        out = np.bincount(shapes.ravel(), weights=np.repeat(x, shapes.shape[1]), minlength=n)
        out[0] = 0
        return out

    def transposed(r):
        return r[shapes].sum(axis=1)

    v = np.ones(len(shapes))
    for _ in range(20):
        v = transposed(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        r = apply(y) - target
        r[0] = 0
        new = np.maximum(0, y - transposed(r) / (1.05 * bound))
        up = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / up * (new - x), new, up
    return x * scale


def part_sizes(b: int) -> list[int]:
    """The 2^k bins that a rest of b bins is cut into, largest first."""
    return [1 << k for k in range(b.bit_length() - 1, -1, -1) if b >> k & 1]


def short_of(window: int = WINDOW, bins: int = BINS) -> int:
    """Up to this length rests are packed into bundles, by their exact length; 0 where bins are exact anyway or a bundle
    would not be 2^k bins."""
    step = -(-window // bins)
    return bins if step > 1 and bins % step == 0 and (bins // step).bit_count() == 1 else 0


def parts_of(length: int, window: int = WINDOW, bins: int = BINS) -> list[tuple[int, int]]:
    """(start, length) of the parts that a piece would be cut into; only the last may fall short of its bins."""
    step = 1 if length <= short_of(window, bins) else -(-window // bins)
    out, at = [], 0
    for size in part_sizes(-(-length // step)):
        out.append((at, min(size * step, length - at)))
        at += out[-1][1]
    return out


def plan(histogram: np.ndarray, bins: int = BINS) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) pairs that use up the histogram exactly, and how many rests of each bin are cut. A pattern holds
    whole rests as their bins and parts as minus their bins. Index = bin; bin 0 is ignored. The number of pairs is bounded
    by the patterns and bins, not by the corpus."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = []
    shapes = patterns(bins)
    x = nnls(shapes, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        used, times = np.unique(shapes[j][shapes[j] > 0], return_counts=True)
        repeats = int(min(int(x[j]), (left[used] // times).min()))
        if repeats:
            left[used] -= times * repeats
            out.append((tuple(int(b) for b in shapes[j] if b), repeats))
    cut = np.zeros_like(left)
    while left.any():
        pattern, repeats, room = _greedy(left, bins)
        if room > GAP:  # its largest rests go to pieces instead
            b = pattern[0]
            cut[b] += left[b]
            left[b] = 0
            continue
        for b in pattern:
            left[b] -= repeats
        out.append((pattern, repeats))
    parts = np.zeros_like(left)
    for b in np.flatnonzero(cut):
        parts[part_sizes(int(b))] += cut[b]
    while parts.any():
        pattern, repeats, _ = _greedy(parts, bins)
        for b in pattern:
            parts[b] -= repeats
        out.append((tuple(-b for b in pattern), repeats))
    return out, cut


def _greedy(left: np.ndarray, bins: int) -> tuple[tuple[int, ...], int, int]:
    """The pattern that takes the largest bin that fits, again and again; how often it can be repeated; the bins it leaves."""
    room, taken, pattern = bins, np.zeros_like(left), []
    while len(fits := np.flatnonzero((left - taken)[: room + 1] > 0)):
        b = int(fits[-1])
        times = min(int(left[b] - taken[b]), room // b)
        pattern += [b] * times
        taken[b] += times
        room -= b * times
    used = np.flatnonzero(taken)
    return tuple(pattern), int((left[used] // taken[used]).min()), room


def _places(made: list[tuple[tuple[int, ...], int]], bins: int) -> tuple[dict, int]:
    """Per bin (and per part, as a negative bin) the first rank of each of its runs, with the run's first sequence and its
    pieces per sequence."""
    runs: dict[int, list] = {b: [] for b in range(-bins, bins + 1)}
    cursor, base = dict.fromkeys(runs, 0), 0
    for pattern, repeats in made:
        for b, times in zip(*(x.tolist() for x in np.unique(pattern, return_counts=True))):
            runs[b].append((cursor[b], base, times))
            cursor[b] += times * repeats
        base += repeats
    return {b: np.array(r, np.int64).reshape(-1, 3) for b, r in runs.items()}, base


class _Layout:
    """Where the n-th rest of a bin, and the n-th part of a size (as a negative bin), has its sequence; full windows are bin 0
    and come last."""

    def __init__(self, histogram: np.ndarray, bins: int):
        made, cut = plan(histogram, bins)
        self.runs, packed = _places(made, bins)
        self.runs[0] = np.array([[0, packed, 1]], np.int64)
        self.sequences = packed + int(histogram[0])
        self.whole = histogram - cut
        self.whole[0] = histogram[0]
        own = [cut * (np.arange(bins + 1) >> k & 1) for k in range(bins.bit_length())]
        self.begin = {1 << k: np.cumsum(x) - x for k, x in enumerate(own)}  # among the parts of 2^k bins, those of bin b

    def sequence(self, kind: int, rank: np.ndarray) -> np.ndarray:
        if not len(rank):
            return np.zeros(0, np.int64)
        run = self.runs[kind][np.searchsorted(self.runs[kind][:, 0], rank, side="right") - 1]
        return run[:, 1] + (rank - run[:, 0]) // run[:, 2]

    def part_rank(self, b: int, size: int, rank: np.ndarray) -> np.ndarray:
        return rank - self.whole[b] + self.begin[size][b]

    def of_rest(self, b: int, rank: np.ndarray) -> np.ndarray:
        """The sequence of rests of 2^k bins, which stay in one piece even where they count as cut."""
        out, stays = np.zeros(len(rank), np.int64), rank < self.whole[b]
        out[stays] = self.sequence(b, rank[stays])
        out[~stays] = self.sequence(-b, self.part_rank(b, b, rank[~stays]))
        return out


def pack(pieces: DataFrame, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """pieces with sequence_id, offset and part added; needs columns doc_id, start, length (1 to window); others pass through.

    A piece that is cut gives one row for each of its parts, with start and length of the part and part = 0, 1, ... as in
    parts_of; otherwise part is -1. Sequences hold at most window tokens; offsets are gapless from 0. Pieces that repeat in
    all columns are each placed. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    step = -(-window // bins)
    blocks = shuffle_partitions(spark)
    taken = {"_bin", "_block", "_rank", "_before", "sequence_id", "offset", "part"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    pieces = settle(pieces)
    names = pieces.columns
    short = short_of(window, bins)
    bundle = short // step
    binned = pieces.withColumn("_bin", F.when(F.col("length") == window, 0).when(F.col("length") <= short, -F.col("length").cast("int")).otherwise(F.ceil(F.col("length") / step).cast("int")))
    binned = binned.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(blocks)).cast("int"))
    sizes = settle(binned.groupBy("_bin", "_block").count())
    histogram, exact = np.zeros(bins + 1, np.int64), np.zeros(bins + 1, np.int64)
    for b, n in sizes.groupBy("_bin").agg(F.sum("count")).collect():  # a row per bin
        (exact if b < 0 else histogram)[abs(b)] = n
    small = _Layout(exact, bins)
    histogram[bundle] += small.sequences if short else 0  # no rest is so short that it shares the bundles' bin
    large = _Layout(histogram, bins)

    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("_bin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("_bin").alias("_b"), F.col("_block").alias("_k"), earlier.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_block", "_bin").orderBy("doc_id", "start", "length")) - 1
    ranked = binned.withColumn("_rank", local).join(bases, (F.col("_bin") == F.col("_b")) & (F.col("_block") == F.col("_k")))
    ranked = ranked.select(*names, "_bin", (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rank = batch.column("_bin").to_numpy(), batch.column("_rank").to_numpy()
            start, length = batch.column("start").to_numpy(), batch.column("length").to_numpy()
            rows: list[list[np.ndarray]] = []  # row, part, start, length, bin or minus part, rank

            def add(at, part, s, n, sequence, rows=rows):
                rows.append([at, np.full(len(at), part), s, n, sequence])

            for b in np.unique(owner).tolist():
                at = np.flatnonzero(owner == b)
                layout, unit = (small, 1) if b < 0 else (large, step)
                stays = rank[at] < layout.whole[abs(b)]
                kept, split = at[stays], at[~stays]

                def place(kind, ranks, b=b, layout=layout):
                    found = layout.sequence(kind, ranks)
                    return large.of_rest(bundle, found) if b < 0 else found

                add(kept, -1, start[kept], length[kept], place(abs(b), rank[kept]))
                done = 0
                for k, size in enumerate(part_sizes(abs(b)) if len(split) else []):
                    n = np.minimum(size * unit, length[split] - done)
                    add(split, k, start[split] + done, n, place(-size, layout.part_rank(abs(b), size, rank[split])))
                    done += size * unit
            at, part, s, n, sequence = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            new = {"start": pa.array(s), "length": pa.array(n)}
            columns = [new.get(c, None) if c in new else batch.column(c).take(pa.array(at)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(part.astype(np.int32))], [*names, "sequence_id", "part"])

    schema = ranked.select(*names).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("part", F.lit(0)).schema
    placed = ranked.mapInArrow(look_up, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"), "part")


def packed_digests(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each placed piece or part."""
    packed = pack(tokenise_pieces(docs, tokenizer_path, digests=True, **how))
    crc = F.when(F.col("part") < 0, F.col("ids_crc32")).otherwise(F.get("part_crc32", F.col("part")))
    return packed.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Tokenise, cut and pack: a row per piece or part with its ids, sequence_id and offset. See tokenise_pieces and pack."""
    packed = pack(tokenise_pieces(docs, tokenizer_path, **how).withColumn("first", F.col("start")))
    ids = F.expr("substring(ids, cast(4 * (start - first) + 1 as int), cast(4 * length as int))")
    return packed.withColumn("ids", ids).drop("first", "part")
