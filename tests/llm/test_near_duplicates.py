import random

from policylog.llm.simhash import drop_near_duplicates, most_shared, near_duplicates, odd_sketch, shingle_set, shingles_of, sketch, words_of


def brute(texts, n=5, similarity=0.8):
    """Each text's smallest linked position, by the exact Jaccard similarity of all pairs."""
    sets = [set(shingles_of(words_of(t), n)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 5 * similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.component_id for r in sorted(near_duplicates(df).collect(), key=lambda r: r.doc_id)]


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_links_inside_families_of_looser_neighbours(spark):
    """Texts of one template: all are loose neighbours of each other, and some have one true near copy each."""
    rng = random.Random(3)
    base, texts = words(rng, 300), []
    for _ in range(60):
        own = list(base)
        for at in range(0, 300, 30):
            own[at] = words(rng, 1)[0]
        texts.append(" ".join(own))
        own[295] = words(rng, 1)[0]
        texts.append(" ".join(own))
    want = brute(texts)
    assert len(set(want)) == 60
    assert components(spark, texts) == want


def test_no_pair_at_the_threshold_is_missed(spark):
    """Many pairs just at 0.8 among other texts: none depends on which sampled bits two fingerprints share."""
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        own = words(rng, 94)
        texts += [" ".join(own), " ".join(own[:84] + words(rng, 10))]
    texts += [" ".join(words(rng, 60)) for _ in range(500)]
    want = brute(texts)
    assert len(set(want)) == 800
    assert components(spark, texts) == want


def test_the_threshold_is_that_of_distinct_shingles(spark):
    rng = random.Random(6)
    texts = []
    for shared in [80, 79] * 40:  # of 90 shingles each: 0.8, and 79 of 101
        own = words(rng, 94)
        texts += [" ".join(own), " ".join(own[: shared + 4] + words(rng, 90 - shared))]
    line = " ".join(words(rng, 10))
    own = " ".join(words(rng, 300))
    texts += [own, f"{own} {f'{line} ' * 100}"]  # a set similarity of 296 / 310
    texts += [f"{' '.join(words(rng, 60))} {f'{line} ' * 100}" for _ in range(3)]
    want = brute(texts)
    assert len(set(want)) == 40 + 80 + 1 + 3
    assert components(spark, texts) == want
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, " ")], "doc_id long, text string")
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == {i for i, x in enumerate(want) if i == x} | {900}


def test_sketches_bound_what_sets_share():
    rng = random.Random(5)
    for n in (1, 3, 40, 700, 6000):
        for part in (0.0, 0.5, 0.95):
            own = words(rng, n)
            other = own[: int(n * part)] + words(rng, rng.randrange(1, n + 2))
            a, b = (shingle_set(" ".join(x), 5) for x in (own, other))
            shared = len(set(a.tolist()) & set(b.tolist()))
            assert shared <= most_shared(sketch(a), sketch(b)) <= min(len(a), len(b))
            differ = (int.from_bytes(odd_sketch(a)) ^ int.from_bytes(odd_sketch(b))).bit_count()
            only_one = len(a) + len(b) - 2 * shared
            assert differ <= only_one and differ % 2 == only_one % 2
            assert only_one > 60 or differ >= only_one - 16
    assert most_shared(bytes([255] * 16), bytes([9] * 16)) == 9 * 16


def test_one_row_of_each_group_stays(spark):
    """Repeated and null ids: rows go by themselves, not by their id."""
    rng = random.Random(7)
    a, b, c = (words(rng, 200) for _ in range(3))
    near = " ".join([*a[:199], "other"])
    a, b, c = (" ".join(x) for x in (a, b, c))
    rows = [(3, a), (3, b), (4, near), (None, b), (None, c), (None, c), (6, a), (6, a), (2, "short"), (2, "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, t int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (3, b), (None, c), (2, "short")], key=str)
    assert drop_near_duplicates(df.limit(0)).count() == 0
