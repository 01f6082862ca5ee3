"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join.

Fingerprints are 64-bit; two link if they differ in at most ``budget`` bits. Fingerprints are dealt to groups by
bit masks: with the ``budget + 1`` masks of :func:`block_masks` any two that link agree on all bits of one mask, so
they meet in a group. Within a group the sorted fingerprints are a binary trie whose nodes are ranges. Pairs of
nodes descend together, one bit a level; each bit in which the two sides part costs one error, and a pair whose errors
exceed the budget is pruned with everything below it. Only a spanning forest of a group's links is returned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylog.llm.common import CACHES, attach_groups, fresh, hash_filter, may_be_in, one_row_each, release_caches, settle, shuffle_partitions, without_rows
from policylog.llm.components import connected_components

SEED = 42
#: A group of more fingerprints than this is dealt anew by interleaved masks, on top of its own.
HOT_GROUP = 50_000
_CHUNK = 65_536


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D; no other character is touched."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """All runs of size words, space-joined, repeats included; fewer words give the whole sequence, none give none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    return [line[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def signature(text: str | None, shingle: int = 4, words: int = 1) -> np.ndarray:
    """So many 64-bit words: the fingerprint, in which bit i is set if it is set in over half of the shingles' XXH64
    values, then the same for values mixed from these. A text without words has zeros."""
    from xxhash import xxh64_intdigest as digest

    parts = shingles_of(words_of(text), shingle)
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(parts), _CHUNK):
        hashes = np.array([digest(x, SEED) for x in parts[at : at + _CHUNK]], np.uint64)
        for k in range(words):
            ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            if k + 1 < words:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                hashes ^= hashes >> np.uint64(29)
    return np.packbits(ones * 2 > len(parts), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return int(signature(text, shingle)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and more (array of further words) for each row; a null text
    counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        for batch in batches:
            made = np.array([signature(x.as_py(), shingle, words) for x in batch.column(1)], np.uint64).reshape(-1, words).view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * (words - 1), pa.int32()), pa.array(made[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[:, 0]), more], ["doc_id", "fp", "more"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, more array<long>")


def block_masks(budget: int, interleaved: bool = False) -> list[int]:
    """budget + 1 masks that share out the 64 bits: whoever differs in at most budget bits agrees on one of them."""
    n = budget + 1
    return [sum(1 << i for i in range(64) if (i % n if interleaved else i * n // 64) == j) for j in range(n)]


def sampled_masks(count: int, bits: int, seed: int = 1) -> list[int]:
    """count masks of so many random bits; for large budgets, where blocks would be too short to tell anything apart."""
    rng = random.Random(seed)
    return [sum(1 << i for i in rng.sample(range(64), bits)) for _ in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(fps: DataFrame, masks: list[int], *under: str) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(m))), *under) for j, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key"))


def trie_links(keys: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of a spanning forest of the links within each group; rows are sorted by key, then by fp (signed).

    Work is a stack of bounded frontiers of node pairs, so memory does not follow the number of pairs. Pairs of nodes
    that are already in one component are pruned as well.
    """
    n = len(fps)
    bits = fps.view(np.uint64) ^ np.uint64(1 << 63)  # signed order becomes the trie's order; distances stay
    labels, run, found = np.arange(n), np.arange(n), []

    def merge(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal labels, run
        changed = False
        while len(u):
            a, b = labels[u], labels[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if not len(u):
                break
            high, first = np.unique(np.maximum(a, b), return_index=True)
            found.append((u[first], v[first]))
            onto = np.arange(n)
            onto[high] = np.minimum(a, b)[first]
            while not np.array_equal(onto, up := onto[onto]):
                onto = up
            labels, changed = onto[labels], True
        if changed:
            run = np.cumsum(np.concatenate(([0], labels[1:] != labels[:-1])))

    near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= budget)) if n > 1 else np.array([], np.int64)
    merge(near, near + 1)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else np.array([], np.int64)
    ends = np.append(starts[1:], n)[: len(starts)]
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    stack = [(63, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a, b, c, d, err = stack.pop()
        if len(a) > _CHUNK // 4:  # so that the stack stays small at any depth
            for at in range(0, len(a), _CHUNK // 4):
                stack.append((bit, *(x[at : at + _CHUNK // 4].copy() for x in (a, b, c, d, err))))
            continue
        same = (run[b - 1] == run[a]) & (run[d - 1] == run[c]) & (labels[a] == labels[c])
        a, b, c, d, err = (x[~same] for x in (a, b, c, d, err))
        pairs = (b - a) * (d - c)
        leaf = (pairs <= 64) | (bit < 0)
        if leaf.any():
            _compare(bits, labels, a[leaf], b[leaf], c[leaf], d[leaf], budget, merge)
        a, b, c, d, err = (x[~leaf] for x in (a, b, c, d, err))
        if not len(a):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((bits >> np.uint64(bit)) & np.uint64(1)))).astype(np.int32)
        up = ones[bit]
        m, k, own = b - (up[b] - up[a]), d - (up[d] - up[c]), a == c
        kids = [(a, m, c, k, err), (m, b, k, d, err), (a, m, k, d, err + 1)]
        cross = ~own
        kids.append((m[cross], b[cross], c[cross], k[cross], err[cross] + 1))
        parts = [np.concatenate([kid[i] for kid in kids]) for i in range(5)]
        live = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= budget) & ~((parts[0] == parts[2]) & (parts[1] - parts[0] < 2))
        stack.append((bit - 1, *(x[live] for x in parts)))
    if not found:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _compare(bits, labels, a, b, c, d, budget, merge) -> None:
    """Tests the fingerprints below leaf pairs one by one, a bounded number at a time, nearest first."""
    width = d - c
    sizes = (b - a) * width
    edges = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 2 * _CHUNK), side="left")
    for lo, hi in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
        if hi == lo:
            continue
        s = sizes[lo:hi]
        at = np.repeat(np.arange(lo, hi), s)
        k = np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)
        u, v = a[at] + k // width[at], c[at] + k % width[at]
        far = np.bitwise_count(bits[u] ^ bits[v])
        good = (u < v) & (far <= budget)
        order = np.argsort(far[good], kind="stable")
        merge(u[good][order], v[good][order])


def _joined(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        for keys, fps in _whole_groups(batches):
            u, v = trie_links(keys, fps, budget)
            yield pa.RecordBatch.from_arrays([pa.array(fps[u]), pa.array(fps[v])], ["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, budget: int, masks: list[int] | None = None, hot: int = HOT_GROUP) -> DataFrame:
    """u, v: a spanning forest, per group, of the links between distinct fingerprints (column fp).

    Without masks the blocks are used and no link's component is lost. Groups of over hot fingerprints are told by a
    count per key (at most masks x 2^bits keys) and dealt anew by interleaved masks, which lose no link either.
    """
    first = masks or block_masks(budget)
    fps = fps.select("fp").distinct()
    keyed = _keyed(fps, first)
    crowded = settle(keyed.groupBy("key").count().where(F.col("count") > hot).select(F.col("key").alias("hot_key")))
    if crowded.count():
        keyed = keyed.join(crowded, F.col("key") == F.col("hot_key"), "left")
        again = _keyed(keyed.where("hot_key is not null").select("fp", "hot_key"), block_masks(budget, interleaved=True), "hot_key")
        keyed = keyed.where("hot_key is null").select("fp", "key").unionByName(again)
    dealt = keyed.select("key", "fp").repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_joined(budget), "u long, v long")


def _least(marked: DataFrame, links: DataFrame, by: str, rank: Column) -> DataFrame:
    """by, least, size: for each value of column by its rows, and the least rank among the rows that links (u, v between such
    values) reach."""
    reps = settle(marked.groupBy(by).agg(F.min(rank).alias("rep"), F.count(F.lit(1)).alias("size")))
    linked = connected_components(links).join(reps, F.col("node") == F.col(by)).select("node", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "at")
    linked = linked.join(least, F.col("root") == F.col("at")).select("node", "least")
    return reps.join(linked, F.col(by) == F.col("node"), "left").select(by, F.coalesce("least", "rep").alias("least"), "size")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest id that links reach, its own included).

    A null text counts as empty; texts without words have fingerprint zero, which links like any other. Rows with a
    null id get the component of their fingerprint but never name one. Repeated rows are returned as often as they
    occur; an empty table gives no rows; other columns are ignored.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"))
    groups = _least(marked, fingerprint_links(marked, budget), "fp", F.col("doc_id"))
    return attach_groups(marked, groups, "fp", "size").select("doc_id", "fp", F.col("least").alias("component_id"))


#: Bits in which the fingerprints of first candidates may differ; the share of the texts whose shingles tell which are common,
#: and how many of these are kept.
NEAR_BITS, SAMPLED, COMMON = 4, 8, 1_000_000
ODD_BITS = 1024
_PAIRS = 1 << 20
_SETS = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """XXH64 of words, each made once per worker; bounded by :func:`_word_hashes`."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word, SEED)
        return value


_WORDS = _WordHashes()


def _forget() -> bool:
    held = bool(_WORDS)
    _WORDS.clear()
    return held


CACHES["words"] = _forget


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > 250_000:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending: a polynomial of the words' XXH64 values, mixed."""
    words = _word_hashes(words_of(text))
    if not len(words):
        return np.array([], np.int64)
    n = max(len(words) - size + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        h = h * _FACTOR + words[k : k + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def set_fingerprint(own: np.ndarray) -> int:
    """As signature does, a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), _CHUNK):
        ones += np.unpackbits(own[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def _share(similarity: float, n: int) -> int:
    """The least whole number that is at least similarity * n."""
    return int(np.ceil(similarity * n - 1e-9))


def sketch(own: np.ndarray) -> bytes:
    """How many hashes fall into each of 2^k buckets by their low bits, as bytes; there are 4 to 8 hashes a bucket from 64 on."""
    bits = max(4, (len(own) // 4).bit_length() - 1)
    return np.minimum(np.bincount(own & ((1 << bits) - 1), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(left: bytes, right: bytes) -> int:
    """No two sets with these sketches share more hashes."""
    a, b = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (left, right))
    a[a == 255] = b[b == 255] = 1 << 40  # may be more
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)).sum())


def odd_sketch(own: np.ndarray) -> bytes:
    """For each of ODD_BITS buckets by the high bits whether it holds an odd number of hashes. Two sets' sketches differ in
    no more bits than there are hashes that only one of them holds, however many both hold."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(64 - ODD_BITS.bit_length() + 1)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


_DESCRIBED = "doc_id long, t long, fp long, sid long, n int, keys array<long>, sketch binary, odd binary"


def _described(shingle: int, similarity: float, common):
    """doc_id, t (of the text), fp, sid (of the set), and where a task meets a set first: its size, its rarest shingles, so
    many that two sets of the similarity share one of them, and its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        release_caches("words")
        known, held = common.value
        seen: set[int] = set()
        for batch in batches:
            fps, sids, sizes, keys, sketches, odds = [], [], [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), shingle)
                sid = int(np.uint64(digest(own.tobytes(), SEED)).view(np.int64))
                fps.append(set_fingerprint(own))
                sids.append(sid)
                if sid in seen or not len(own):
                    sizes.append(None), keys.append(None), sketches.append(None), odds.append(None)
                    continue
                if len(seen) >= _SETS:
                    seen.clear()
                seen.add(sid)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, held[at], 0)
                sizes.append(len(own))
                keys.append(own[np.lexsort((own, rank))][: len(own) - _share(similarity, len(own)) + 1])
                sketches.append(sketch(own))
                odds.append(odd_sketch(own))
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(odds, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _DESCRIBED.replace(",", "").split()[::2])

    return run


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least two texts hold, of one in SAMPLED, ascending, and how many hold them; the COMMON most frequent.
    They only set the order in which shingles are taken: any sample gives the same result, a good one fewer candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle))], ["x"])

    held = texts.where(F.pmod("t", F.lit(SAMPLED)) == 0).mapInArrow(run, "x long").groupBy("x").count().where("count > 1")
    rows = held.orderBy(F.desc("count"), "x").limit(COMMON).toArrow()
    found, held = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(found)
    return found[order], held[order]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first column, cut only where its value changes."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows > 4 * _CHUNK and held[0][0][0] != held[-1][0][-1]:
            columns = [np.concatenate(c) for c in zip(*held)]
            stop = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1
            yield [c[:stop] for c in columns]
            held, rows = [[c[stop:].copy() for c in columns]], rows - stop
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted values the first row of its run and the first row after it."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    width = np.diff(np.append(starts, len(values)))
    return np.repeat(starts, width), np.repeat(starts + width, width)


def _can_be(similarity: float, n: np.ndarray, pos: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether rows u and v of a key leave room for the similarity if the key is the first shingle that their sets share."""
    return np.minimum(n[u] - pos[u], n[v] - pos[v]) >= np.ceil(similarity / (1 + similarity) * (n[u].astype(np.int64) + n[v]) - 1e-9)


def _met(similarity: float):
    """The rows of keys that two sets hold, with the key's first set where it can be similar and else the row's own. Rows
    are sorted by key and sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        for key, sid, n, pos in _whole_groups(batches):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
            key, sid, n, pos = key[new], sid[new], n[new], pos[new]
            first, end = _edges(key)
            good = end - first > 1
            star = np.where(_can_be(similarity, n, pos, first, np.arange(len(key))), sid[first], sid)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (key, sid, n, pos, star)], ["key", "sid", "n", "pos", "first"])

    return run


def _few_odd(similarity: float, n: np.ndarray, odd: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the odd sketches of rows u and v leave room for the similarity."""
    good = np.empty(len(u), bool)
    for at in range(0, len(u), _CHUNK):
        a, b = u[at : at + _CHUNK], v[at : at + _CHUNK]
        total = n[a].astype(np.int64) + n[b]
        shared = (total - np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)) // 2
        good[at : at + _CHUNK] = shared >= np.ceil(similarity / (1 + similarity) * total - 1e-9)
    return good


def _unmerged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that sets of several labels hold; rows are sorted by key and label."""
    release_caches("words")
    for columns in _whole_groups(batches):
        first, end = _edges(columns[0])
        several = columns[1][first] != columns[1][end - 1]
        yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in columns], ["key", "label", "sid", "n", "pos"])


def _cross_pairs(similarity: float):
    """All pairs of a key's sets that are not linked yet and that can be similar; rows are sorted by key and label. A pair's
    first common shingle bounds what they share by what is left of both, and their odd sketches by what only one of them
    holds, so no pair of the similarity is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        for key, label, sid, n, pos, odd in _whole_groups(batches):
            odd = np.frombuffer(b"".join(odd), np.uint64).reshape(len(key), -1)
            _, end = _edges(key)
            own = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (label[1:] != label[:-1]))))
            own = np.repeat(np.append(own[1:], len(key)), np.diff(np.append(own, len(key))))  # where the row's label ends
            left = end - own
            at = 0
            total = np.concatenate(([0], np.cumsum(left)))
            while at < len(key):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, side="right")) - 1)
                size = left[at:stop]
                for skip in range(0, max(int(size.max()), 1), _PAIRS):  # more than one step only for a single row
                    take = np.clip(size - skip, 0, _PAIRS)
                    u = np.repeat(np.arange(at, stop), take)
                    v = own[u] + skip + np.arange(len(u)) - np.repeat(np.cumsum(take) - take, take)
                    good = _can_be(similarity, n, pos, u, v)
                    u, v = u[good], v[good]
                    good = _few_odd(similarity, n, odd, u, v)
                    a, b = sid[u[good]], sid[v[good]]
                    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])
                at = stop

    return run


def _may_share(similarity: float):
    """Pairs whose sketches leave room for the similarity; it loses none that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            most = np.array([most_shared(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(5))], np.int64)
            good = pa.array(most >= np.ceil(similarity / (1 + similarity) * n - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    return run


def _similar(pairs: DataFrame, made: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs u, v of set ids whose shingle sets have a Jaccard similarity of at least similarity. Sketches settle most
    pairs; the texts of the others are read again, and only theirs are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("words")
        last, mine = None, np.array([], np.int64)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                if u[i] != last:
                    last, mine = u[i], shingle_set(left.as_py(), shingle)
                other = shingle_set(right.as_py(), shingle)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                good[i] = shared >= similarity * (len(mine) + len(other) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])

    pairs = settle(pairs)
    asked = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    sketches = made.where("sketch is not null").select("sid", "n", "sketch").join(asked, "sid", "left_semi").dropDuplicates(["sid"])
    left, right = (sketches.select(F.col("sid").alias(f"{x}_sid"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "uv")
    both = pairs.join(right, F.col("v") == F.col("v_sid")).join(left, F.col("u") == F.col("u_sid"))
    pairs = settle(both.select("u", "v", "u_n", "u_sketch", "v_n", "v_sketch").mapInArrow(_may_share(similarity), "u long, v long"))

    asked = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    chosen = settle(made.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min("t").alias("t")))
    read = may_be_in(texts, F.col("t"), hash_filter(F.col("t"), chosen), "_asked").where("_asked").select("t", "text")
    read = read.join(chosen.select("t"), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    bodies = settle(chosen.join(read, "t").select("sid", "text"))
    left, right = (bodies.select(F.col("sid").alias(f"{x}_sid"), F.col("text").alias(f"{x}_text")) for x in "uv")
    full = pairs.join(right, F.col("v") == F.col("v_sid")).select("u", "v", "v_text").join(left, F.col("u") == F.col("u_sid"))
    return settle(full.select("u", "v", "u_text", "v_text").sortWithinPartitions("u").mapInArrow(run, "u long, v long"))


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The described rows, and the links between the ids of similar sets."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(_common_shingles(texts.select("t", "text"), shingle))
    made = settle(texts.select("doc_id", "t", "text").mapInArrow(_described(shingle, similarity, common), _DESCRIBED))
    texts = texts.select("t", "text")
    parts = shuffle_partitions(spark)
    keyed = made.where("keys is not null").select("sid", "n", F.posexplode("keys").alias("pos", "key")).select("key", "sid", "n", "pos")
    met = settle(keyed.repartition(parts, "key").sortWithinPartitions("key", "sid").mapInArrow(_met(similarity), "key long, sid long, n int, pos int, first long"))

    reps = made.groupBy("fp").agg(F.min("sid").alias("sid"))
    ends = [reps.select(F.col("fp").alias(f"{x}_fp"), F.col("sid").alias(f"{x}_sid")) for x in "uv"]
    near = fingerprint_links(made, NEAR_BITS).join(ends[0], F.col("u") == F.col("u_fp")).join(ends[1], F.col("v") == F.col("v_fp")).select(F.col("u_sid").alias("u"), F.col("v_sid").alias("v"))
    sets = made.select("fp", "sid").distinct()
    same = sets.join(reps.select(F.col("fp").alias("u_fp"), F.col("sid").alias("u")), F.col("fp") == F.col("u_fp")).select("u", F.col("sid").alias("v"))
    pairs = near.unionByName(same).unionByName(met.select(F.col("first").alias("u"), F.col("sid").alias("v"))).where("u <> v")
    links = _similar(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), made, texts, shingle, similarity)

    roots = connected_components(links)
    labelled = met.join(roots, F.col("sid") == F.col("node"), "left").select("key", F.coalesce("root", "sid").alias("label"), "sid", "n", "pos")
    open_rows = labelled.repartition(parts, "key").sortWithinPartitions("key", "label").mapInArrow(_unmerged, "key long, label long, sid long, n int, pos int")
    odd = made.where("odd is not null").select("sid", "odd").dropDuplicates(["sid"])
    rest = open_rows.join(odd, "sid").select("key", "label", "sid", "n", "pos", "odd").repartition(parts, "key").sortWithinPartitions("key", "label")
    rest = rest.mapInArrow(_cross_pairs(similarity), "u long, v long").distinct()
    return made, settle(links.unionByName(_similar(rest, made, texts, shingle, similarity)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, fp (of the distinct shingles), component_id, where rows link whose sets of distinct
    shingles have a Jaccard similarity of at least similarity. Edge cases as in cluster; sets are told apart by 64-bit hashes.

    Every link is settled on the shingles themselves. First candidates are fingerprints that differ in few bits, found by the
    trie join, and the first set of each key, where a set's keys are its rarest shingles: two sets of the similarity share
    one of them at least, at any number of documents. What these link is merged. Then all pairs under one key that are in
    different components are settled as well, so no pair at the threshold is missed, and large groups of copies stay cheap.
    """
    made, links = _linked(docs, id_col, text_col, shingle, similarity)
    marked = made.select("doc_id", "fp", "sid")
    groups = _least(marked, links, "sid", F.col("doc_id"))
    return attach_groups(marked, groups, "sid", "size").select("doc_id", "fp", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with exactly one row of each group of near duplicates, the one with the smallest id; all columns stay. A null id
    comes after all others, and of rows that share the smallest id the one whose text has the smaller hash stays; of rows
    that repeat both, one stays, whichever the cluster meets first."""
    made, links = _linked(docs, id_col, text_col, shingle, similarity)
    marked = made.select("doc_id", "t", "sid")
    groups = _least(marked, links, "sid", F.struct(F.col("doc_id").isNull(), "doc_id", "t"))
    best = attach_groups(marked, groups, "sid", "size")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t") == F.col("least.t"))
    dropped = settle(best.where(~stays).select("doc_id", F.col("t").alias("digest")).distinct())
    repeated = settle(marked.groupBy("doc_id", F.col("t").alias("digest")).count().where("count > 1").select("doc_id", "digest"))
    ident, digest = fresh("_long_id", docs), F.xxhash64(F.col(text_col).cast("string"))
    found = without_rows(docs.withColumn(ident, F.col(id_col).cast("long")), ident, digest, dropped)
    return one_row_each(found, ident, digest, repeated).select(*docs.columns)
