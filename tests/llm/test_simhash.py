import random

import numpy as np
import pytest

from policylog.llm.components import connected_components
from policylog.llm.simhash import block_masks, cluster, fingerprint, trie_links


def brute(fps, budget):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("budget", [0, 1, 4, 12])
def test_trie_forest_equals_all_pairs(budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({(b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))})) for b in base for _ in range(12)})
    signed = np.sort(np.array(fps, np.uint64).view(np.int64))
    u, v = trie_links(np.zeros(len(signed), np.int64), signed, budget)
    value = [int(x) & (1 << 64) - 1 for x in signed]
    want = brute(value, budget)
    assert all((value[a] ^ value[b]).bit_count() <= budget for a, b in zip(u, v))
    assert len(u) == len(value) - len(set(want.values()))
    assert all(want[value[a]] == want[value[b]] for a, b in zip(u, v))


def test_masks_share_out_the_bits():
    for budget in (0, 4, 10):
        for mixed in (False, True):
            masks = block_masks(budget, mixed)
            assert len(masks) == budget + 1 and sum(masks) == (1 << 64) - 1


def test_fingerprint_by_hand():
    import xxhash

    assert fingerprint(None) == fingerprint(" \t\x0b") == 0
    assert fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    text = "One two three four FIVE two\x85three"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert fingerprint(text) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_cluster_equals_all_pairs(spark, hot, monkeypatch):
    import policylog.llm.simhash as simhash

    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (None, hot))
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((1, 5, 300)))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = "other"
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, "w1"), (3, rows[3][1]), (9000, "long " * 50_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, rep string")
    got = cluster(df).collect()
    fps = {r: fingerprint(r[1]) for r in rows}
    comp = brute(sorted(set(fps.values())), 4)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted((str(i), least.get(comp[f])) for (i, t) in rows for f in [fps[i, t]])
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    assert cluster(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
