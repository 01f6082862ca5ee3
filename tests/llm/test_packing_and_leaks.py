import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from policylog.llm import decontaminate as dc
from policylog.llm.packing import nnls, pack, pack_documents, patterns, plan

SF = "/root/testdata/sf0.01"


def check_sequences(rows, window=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return by


def test_packing_keeps_every_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma.", "é"], k=rng.choice((0, 3, 500, 6000))))) for i in range(60)] + [(100, None), (101, ""), (None, "no id"), (5, "again"), (5, "again")]
    got = pack_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int"), path).collect()
    check_sequences(got)
    texts = defaultdict(list)
    for r in got:
        texts[r.doc_id].append(r)
    for i, t in rows:
        if i != 5:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            own = sorted(texts[i], key=lambda r: r.start)
            assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids and own[0].doc_tokens == len(ids)
    assert sum(r.length for r in texts[5]) == len(whole.encode(rows[5][1], add_special_tokens=False).ids) + 1 + 2 * (len(whole.encode("again", add_special_tokens=False).ids) + 1)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_little_padding_and_even_shares(spark):
    from policylog.llm.queries import op5_packing

    got = op5_packing(spark, SF).collect()
    by = check_sequences(got)
    assert sum(r.length for r in got) / (4096 * len(by)) > 0.985
    for length in (2500, 4000, 1, 3, 100, 511, 513, 700):
        same = spark.range(3000).selectExpr("id as doc_id", "0L as start", f"{length}L as length")
        rows = pack(same).collect()
        assert sum(r.length for r in rows) == 3000 * length
        assert len(check_sequences(rows)) <= -(-3000 * length // 4096) * (1.014 if length > 512 else 1.005) + 1, length
    assert len(check_sequences(pack(spark.range(3000).selectExpr("id as doc_id", "0L as start", "1L as length")).collect())) == 1


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    for h in (np.zeros(257, int), rng.integers(0, 2000, 257), np.eye(257, dtype=int)[100] * 999, rng.integers(0, 2, 257)):
        h[0] = 0
        used = np.zeros(257, int)
        made, cut = plan(h, 256)
        parts = np.zeros(257, int)
        for pattern, repeats in made:
            assert sum(map(abs, pattern)) <= 256 and repeats > 0
            for b in pattern:
                used[b] += repeats * (b > 0)
                parts[max(0, -b)] += repeats * (b < 0)
        assert (used + cut == h).all()
        want = np.zeros(257, int)
        for b in np.flatnonzero(cut):
            for k in range(9):
                want[1 << k] += cut[b] * (b >> k & 1)
        assert (parts[1:] == want[1:]).all()
        if h.sum():
            assert sum(n for _, n in made) <= 1.01 * (np.arange(257) * h).sum() / 256 + 2


def test_nnls_finds_an_exact_solution():
    shapes = patterns(12)
    assert all(s.sum() == 12 for s in shapes) and len({tuple(s) for s in shapes}) == len(shapes)
    truth = np.random.default_rng(0).integers(0, 50, len(shapes)) * 1.0
    h = np.bincount(shapes.ravel(), weights=np.repeat(truth, 3), minlength=13)
    h[0] = 0
    x = nnls(shapes, h, 4000)
    made = np.bincount(shapes.ravel(), weights=np.repeat(x, 3), minlength=13)[1:]
    assert (x >= 0).all() and np.abs(made - h[1:]).max() < 0.01 * h.max()


# -- benchmark leaks ------------------------------------------------------------------------------------------------------


def test_lcs_against_the_table():
    def table(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    rng = random.Random(0)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(1, 15)) for _ in range(2))
        assert dc.lcs_length(a, b) == table(a, b)


def test_latent_space_equals_the_svd(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((40, 25)) < 0.2) * rng.random((40, 25))
    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for r in a]
    df = spark.createDataFrame(rows, "terms array<int>, weights array<double>")
    space = dc.latent_space(df, 25, rank=20, extra=5)
    assert np.allclose(space.T @ space, np.eye(20), atol=1e-6)
    _, s, _ = np.linalg.svd(a)
    assert np.allclose(np.sort(np.linalg.norm(a @ space, axis=0))[::-1], s[:20], rtol=1e-6)


def test_all_planted_leaks_and_nothing_else(spark):
    """Recall and precision against all runs of eight words that a document shares with an item."""
    from policylog.llm.queries import op3_decontaminate

    def runs(text):
        w = text.lower().split()
        return {" ".join(w[i : i + 8]) for i in range(max(1, len(w) - 7))}

    items = {r.item_id: runs(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = runs(r.text)
        want |= {(r.doc_id, i) for i, x in items.items() if own & x}
    got = {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, SF).collect()}
    assert len(want) > 10 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    docs = [" ".join(word() for _ in range(rng.choice((5, 200, 900)))) for _ in range(80)]
    items = [" ".join(word() for _ in range(n)) for n in (10, 30, 47, 130)]
    return rng, word, docs, items


def test_copies_paraphrases_and_answers(spark, corpus):
    rng, word, docs, items = corpus
    docs = list(docs)
    want = set()
    for n, item in enumerate(items):
        w = item.split()
        exact, light = docs[n].split(), docs[10 + n].split()
        exact[3:3] = w
        altered = [word() if rng.random() < 0.15 else x for x in w]
        light[2:2] = altered
        docs[n], docs[10 + n] = " ".join(exact), " ".join(light)
        want |= {(n, n), (10 + n, n)}
    rows = [(i, t, 1) for i, t in enumerate(docs)] + [(500, None, 1), (501, "", 1), (None, docs[0], 1), (0, docs[0], 1), (502, items[1].upper() + " x " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, ""), (None, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()}
    assert got == want | {(None, 0), (502, 1)}
    blocks = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench, block=2).collect()}
    assert blocks == got
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0
    words = items[1].split()
    half = " ".join(words[:20] + [word() for _ in range(10)])
    one = spark.createDataFrame([(1, half)], "doc_id long, text string")
    for answer, found in ((words[5], 1), ("elsewhere", 0)):
        asked = spark.createDataFrame([(1, items[1], answer)], "item_id long, text string, answer string")
        assert dc.contaminated(df.unionByName(one, allowMissingColumns=True).where("doc_id = 1"), asked, answer_col="answer").where("item_id = 1 and n_words = 30 and lcs < 25").count() == found


def test_finds_equal_brute_force(spark):
    """Every window against every passage by the LCS rule alone, for copies with more and more words altered."""
    rng = random.Random(21)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    docs = [dc.words_of(r.text)[:600] for r in rows[:120]]
    prose = sorted({w for d in docs for w in d})
    items = [rng.choices(prose, k=n) for n in (8, 15, 30, 48, 48, 90)]
    for k, d in enumerate(docs[:90]):
        item = items[k % 6]
        share = (k // 6) / 14 * 0.45
        d[10:10] = [rng.choice(prose) if rng.random() < share else w for w in item]
    want = set()
    for k, d in enumerate(docs):
        for i, item in enumerate(items):
            for _, own in dc.passages_of(item):
                for s in range(0, max(len(d) - dc.WINDOW, 0) + dc.STEP, dc.STEP):
                    region = d[max(0, s - dc.STEP) : s + dc.WINDOW + dc.STEP]
                    lcs = dc.lcs_length(own, region)
                    uncommon = set(own)
                    if lcs >= dc._need(len(own)) and (lcs >= dc.ALIKE * len(own) or 2 * len(uncommon & set(region)) >= len(uncommon)):
                        want.add((k, i))
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()}
    assert len(want) > 60 and got == want
    clean = dc.drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_leaky_rows_go_one_by_one(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    item, other = (" ".join(word() for _ in range(40)) for _ in range(2))
    df = spark.createDataFrame([(1, item, "x"), (1, other, "x"), (None, item, "y"), (None, None, "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (None, other)], "item_id long, text string")
    got = dc.drop_contaminated(df, bench)
    assert got.columns == df.columns and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, other, "x"), (None, None, "y"), (2, "", "z"), (2, "", "z")]))
    assert dc.drop_contaminated(df, bench.limit(0)).count() == 6 and dc.drop_contaminated(df.limit(0), bench).count() == 0
    space = dc.make_block(spark, [dc.Passage(0, 0, dc.words_of(item), [])], {w: i for i, w in enumerate(sorted(set(item.split())))}, np.full(len(set(item.split())), 0.1), np.zeros(40, bool))
    assert space.least.tolist() == [-1], "words that weigh next to nothing are compared as words"
