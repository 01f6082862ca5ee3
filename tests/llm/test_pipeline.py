import corpus_pipeline
from policylog.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, each held against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        assert k == 4 or docs.columns == columns
    rows = [{r.doc_id: r.text for r in o.collect()} for o in outs[:4]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where(crc_mod("doc_id", 5) == 0).collect()}
    wrong = sum((d in rows[0]) != bool(q) for d, q in labels.items())
    assert wrong <= 0.1 * len(labels)

    keep = {}
    for d, t in rows[0].items():
        keep[t] = max(d, keep.get(t, d))
    assert rows[1].keys() == set(keep.values())

    sets = {d: shingles(t) for d, t in rows[1].items()}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    similar = {}
    for d, s in sets.items():
        for e in {e for x in s for e in by[x] if e < d}:
            similar[d, e] = len(s & sets[e]) / len(s | sets[e])
    left = [p for p, j in similar.items() if j >= 0.85 and p[0] in rows[2] and p[1] in rows[2]]
    assert not left, "pairs well above the threshold are not both kept"
    for d in rows[1].keys() - rows[2].keys():
        assert any(d in p and j >= 0.7 for p, j in similar.items()), "what goes has a near copy"

    runs = set().union(*(shingles(r.text, 8) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert rows[3].keys() == {d for d, t in rows[2].items() if not shingles(t, 8) & runs}

    packed = outs[4].collect()
    assert {r.doc_id for r in packed} == rows[3].keys()
    total = {}
    for r in packed:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 4096
    assert corpus_pipeline.ORACLE_SQL is None
