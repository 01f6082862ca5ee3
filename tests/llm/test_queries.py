"""The registered queries on a whole small table, against the libraries and plain versions."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from policylog.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = q.queries()[name](spark, SF)
    assert set(columns) == set(got.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want))


def test_token_store_and_counts(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*whole.encode(t, add_special_tokens=False).ids, 0] for d, t in docs.items()}
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        start += len(ids[d])
    assert sorted(map(tuple, q.op2_token_store(spark, SF).collect())) == want
    counts = sorted(map(tuple, q.op6_token_counts(spark, SF).collect()))
    assert counts == [(d, len(docs[d].encode()), len(ids[d]) - 1, len(ids[d]) - 1 > 1024) for d in sorted(docs)]


def test_packing(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*whole.encode(t, add_special_tokens=False).ids, 2] for d, t in docs.items()}
    seen = {d: 0 for d in docs}
    for r in sorted(q.op5_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert seen == {d: len(x) for d, x in ids.items()}


def test_simhash(spark, docs):
    def fingerprint(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        parts = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(map(tuple, q.op7_simhash(spark, SF).collect())) == sorted((d, f"{f:016x}", find(d)) for d, f in fps.items())


def test_personal_data(spark, docs):
    import hashlib

    from .test_models import plain_base

    for r in q.op9_pii(spark, SF).collect():
        base = plain_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r.spans.split(","))


def test_ten_queries_and_no_more():
    assert sorted(q.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(q.queries()) and len(q.queries()) == 10
