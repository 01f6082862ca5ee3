import random
import zlib

import numpy as np
import pytest

from policylog.llm import language_id, pii, quality
from policylog.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    from policylog.llm.queries import op1_language_id

    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_backoff_by_hand():
    model = language_id.Model(["de", "en"], {0: {"the": np.array([0, 9.0]), "der": np.array([9.0, 0])}, 2: {"sc": np.array([5.0, 1]), "wh": np.array([0, 5.0])}})
    assert [int(np.argmax(model.vector(w))) for w in ("the", "der", "schule", "whale")] == [1, 0, 0, 1]
    assert not any(model.vector("zzz")), "unknown in every length says nothing"
    assert language_id.words_of("A½b ½ 12_x") == {"a": 1, "b": 1, "x": 1}


def test_language_against_a_plain_version(spark, tmp_path):
    """The whole query on a small table: counts, backoff, sums and winner, each in the plainest way."""
    import math
    import re
    from collections import Counter

    from policylog.llm.queries import op1_language_id

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()[:60]
    rows += [(None, "la casa", None), (None, "the house", "en"), (2000, None, "en"), (2001, "123 !", "de")]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    split = lambda t: Counter(w for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    learn = [(t, g) for i, t, g in rows if t is not None and g is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({g for _, g in learn})
    counts = {n: {g: Counter() for g in langs} for n in range(6)}
    for t, g in learn:
        counts[0][g].update(split(t).keys())
        for n in range(1, 6):
            counts[n][g].update(x for w in split(t) for x in language_id.grams_of(w, n))
    known = {n: set().union(*c.values()) for n, c in counts.items()}
    log = lambda n, x, g: math.log((counts[n][g][x] + 0.5) / (sum(counts[n][g].values()) + 0.5 * len(known[n])))

    def vector(w):
        if w in known[0]:
            return [log(0, w, g) for g in langs]
        for n in range(5, 0, -1):
            if hits := [x for x in language_id.grams_of(w, n) if x in known[n]]:
                return [sum(log(n, x, g) for x in hits) / len(hits) for g in langs]
        return [0.0] * len(langs)

    texts = Counter((i, t) for i, t, _ in rows)
    for r in op1_language_id(spark, str(tmp_path)).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        fits = []
        for t in [t for i, t in texts if i == r.doc_id]:
            z = [sum(c * v for c, v in zip(split(t).values(), x)) for x in zip(*map(vector, split(t)))]
            fits.append((langs[z.index(max(z))], 1 / sum(math.exp(x - max(z)) for x in z)) if z else ("und", 0.0))
        assert any(r.lang_pred == p and r.score == pytest.approx(x, abs=1e-6) for p, x in fits)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 !? ½", "en"), (None, "the dog", None), (1, "the cat and the dog", "en"), (6, "der " * 30_000, "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == ["en", "en", "de", "und", "und", "und", "de", "en"]
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"} and language_id.identify(df.limit(0), none).count() == 0


def test_quality_on_held_out_rows(spark):
    from policylog.llm.queries import op10_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op10_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        chunks = quality.chunks_of(data)
        joined = bytes(chunks[0]) + b"".join(bytes(c[quality.OVERLAP :]) for c in chunks[1:])
        assert joined.rstrip(b"\0") == data and len(joined) - n < quality.CHUNK + 1


def test_pooling_equals_a_plain_convolution():
    model = quality.Model()
    chunks = quality.chunks_of(bytes(range(1, 256)) * 3)
    starts = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
    plain = np.array([[max(max(0.0, float(model.embed[c[s : s + quality.WIDTH]].ravel() @ model.filters[:, f] + model.bias[f])) for s in starts) for f in range(3)] for c in chunks])
    assert np.allclose(model.pooled(chunks)[:, :3], plain, atol=1e-4)
    text = "ab" * 4000
    assert model.score_text(text, block=5) == pytest.approx(model.score_text(text), abs=1e-6)


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "y" * 200_000), (3, "y" * 200_000), (4, "fine words here")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 0), (3, 1), (4, 1), (1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), quality.train(df, labels.limit(0))).count() == 0
    model = quality.train(df, labels)
    kept = quality.keep_good(df, model, 0.0)
    assert kept.columns == df.columns and kept.count() == len(rows) and quality.keep_good(df, model, 1.1).count() == 0


def test_query_scores_equal_a_plain_network(spark, tmp_path):
    """op10 over whole texts: every window of every chunk, one at a time."""
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(crc_mod("doc_id", 5) != 0))
    texts = ["", None, "plain words", "ü" * 300, "word " * 400]
    for text in texts:
        data, rows = (text or "").encode(), []
        for at in range(0, max(1, len(data) - quality.OVERLAP), quality.CHUNK - quality.OVERLAP):
            chunk = np.frombuffer(data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
            windows = [model.embed[chunk[s : s + quality.WIDTH]].ravel() for s in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            rows.append(np.maximum(np.stack(windows) @ model.filters + model.bias, 0).max(axis=0))
        pooled = np.stack(rows)
        z = np.concatenate((pooled.mean(axis=0), pooled.max(axis=0))) @ model.out + model.base[0]
        assert model.score_text(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.score == pytest.approx(model.score_text(texts[r.doc_id])) for r in quality.score(df, model).collect())


# -- personal data -------------------------------------------------------------------------------------------------------


def plain_base(text):
    """The base patterns, run as they are."""
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    parts = ["a@b.com", "x.y+z@d-e.co.uk", "@", "a@b", "@c.de@f.gh", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "9" * 20, " ", ".", "é", "-", "00001.2.3.4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert pii.base_spans(text) == plain_base(text), repr(text)


def test_estimation_tells_good_labelers_from_bad():
    good, bad = (1, 1, 1, 1, -1), (-1, 0, 0, 0, 0)
    odd = (-1, 1, 1, 0, -1)
    counts = {("phone", good): 500, ("phone", bad): 500, ("phone", odd): 5}
    p = pii.estimate(counts)
    assert p["phone", good] > 0.9 > 0.1 > p["phone", bad]
    text = "call 555 123 4567"
    of = lambda answers: tuple(pii.cells(text, "phone", 5, len(text), answers))
    theta = pii.train({(*k, of(k[1])): n for k, n in counts.items()})
    chance = lambda answers: 1 / (1 + np.exp(-theta[list(of(answers))].sum()))
    assert chance(good) > 0.8 and chance(bad) < 0.2 and not pii.train({}).any()


def test_estimation_equals_plain_em():
    """One span at a time instead of counted patterns."""
    rng = random.Random(4)
    spans = []
    for _ in range(400):
        real = rng.random() < 0.4
        spans.append(tuple(rng.choice((-1, int(rng.random() < (0.85 if real else 0.2)))) for _ in range(pii.LABELERS)))
    counts = {("card", v): spans.count(v) for v in set(spans)}
    p = {v: (sum(a == 1 for a in v) + 0.5) / (sum(a >= 0 for a in v) + 1) for v in spans}
    for _ in range(50):
        prior = min(max((sum(p[v] for v in spans) + 1) / (len(spans) + 2), 0.01), 0.99)
        table = {}
        for j in range(pii.LABELERS):
            for a in (-1, 0, 1):
                yes, no = (sum(w(v) for v in spans if v[j] == a) + 1 for w in (lambda v: p[v], lambda v: 1 - p[v]))
                table[j, a] = (yes / (sum(p[v] for v in spans) + 3), no / (sum(1 - p[v] for v in spans) + 3))
        new = {}
        for v in set(spans):
            yes, no = prior, 1 - prior
            for j, a in enumerate(v):
                yes, no = yes * table[j, a][0], no * table[j, a][1]
            new[v] = yes / (yes + no)
        p = new
    got = pii.estimate(counts)
    assert all(got["card", v] == pytest.approx(p[v], abs=1e-6) for v in p)


def test_long_runs_take_linear_time():
    import time

    texts = ["1" * 400_000, "1.2.3.4." * 50_000, "(555) 123-4567 a@b.com " * 8_000, "+1 " * 100_000, "1." * 200_000, "a" * 400_000 + "@"]
    for text in texts:
        begin = time.process_time()
        base = pii.base_spans(text)
        loose = pii.loose_spans(text, base)
        taken = sorted([(s, e) for _, s, e in base])
        assert time.process_time() - begin < 8, text[:9]
        assert len(loose) + len(taken) > 0 or "1.2" not in text


def test_personal_data_edge_cases(spark):
    texts = ["mail me: a@b.com or c (at) d (dot) org", None, "", "call +1 555 123 4567 or phone (555) 123-4567 now", "4111 1111 1111 1111 " * 5000, "nothing", "+" + "1" * 5000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "x@y.de", "s"), (0, texts[0], "s")], "doc_id long, text string, spans string")
    got = pii.find_personal_data(df).collect()
    assert len(got) == 9
    for r in got:
        text = "x@y.de" if r.doc_id is None else texts[r.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_base(text) or len(text) > 9000
        assert [(pii.KINDS.index(s.kind), s.start) for s in r.spans] == sorted((pii.KINDS.index(s.kind), s.start) for s in r.spans)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_split_columns(spark):
    got = spark.range(50).select(crc_mod("id", 4).alias("m"), "id").collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in got)
