import hashlib
import random

from pyspark.sql import functions as F

from policylog.llm import common
from policylog.llm.exact_dedup import drop_duplicates, mark_duplicates
from policylog.llm.queries import URL_RULES, oracle_sql
from policylog.llm.url_filter import match_rules


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "b", "x" * 100_000, "x" * 99_999 + "y", "é", "e", "A", "same " * 30 + "1", "same " * 30 + "2"]
    rows = [(i, rng.choice(texts), "k") for i in range(200)] + [(500, "alone", "k"), (None, "nobody", "k"), (None, "a", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, full_hash string")
    got = sorted(mark_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    want = []
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert mark_duplicates(df.limit(0)).count() == 0 and drop_duplicates(df.limit(0)).count() == 0


ODD = [(5, "A"), (5, "B"), (9, "B"), (None, "C"), (None, "B"), (9, "B"), (7, None), (8, ""), (None, "D"), (None, "D")]


def test_null_and_repeated_ids(spark, tmp_path):
    """One row out per row in, each with its own digest; the filter leaves exactly one row of each text."""
    from policylog.llm.queries import op8_exact_dedup

    spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, keep_id string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_exact_dedup(spark, str(tmp_path)).collect()
    want = []
    for i, t in ODD:
        same = [j for j, u in ODD if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)
    kept = drop_duplicates(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "A"), ("8", ""), ("9", "B"), ("None", "C"), ("None", "D")]


def test_filters_and_hot_groups(spark):
    """The hash filter passes every key, and rows meet their group whether it is hot or not."""
    df = spark.range(-3000, 3000).selectExpr("id", "xxhash64(id) as h", "if(id < 0, null, if(id < 2000, 7, id)) as g")
    kept = common.may_be_in(df, F.col("h"), common.hash_filter(F.col("h"), df.where("id % 7 = 0")), "hit")
    assert kept.where("hit").count() < 900 and kept.where("id % 7 = 0 and not hit").count() == 0 and kept.count() == 6000
    groups = df.where("g is not null").groupBy("g").agg(F.count("id").alias("size"), F.min("id").alias("least")).where("g % 3 > 0")
    got = common.attach_groups(df, groups, "g", "size")
    assert got.columns == ["id", "h", "g", "size", "least"] and got.count() == 6000
    assert all((r["size"], r.least) == ((None, None) if r.g is None or r.g % 3 == 0 else (2000, 0) if r.g == 7 else (1, r.id)) for r in got.collect())


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "xexample.com", "example-x.com", "net", "a.net", "b.a.net", "com", ".com", "com.", "example.com:80", "", "日本.com", "net.com", "org"]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/", "/EN/", "?q=/en/", "#/en/", "/en/?a#b", "/en/a/b"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://example.com\n/en/", "http://example.com/en/" + "x" * 50_000, urls[0], urls[0]]
    df = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)] + [(None, urls[1], "k", "r"), (3, urls[3], "k", "r")], "page_id long, url string, key string, rule string")
    rules = spark.createDataFrame([(*r, 1) for r in URL_RULES] + [("b.a.net", "/es/", "allow", 1), ("com", "/", "allow", 2), (None, "/", "block", 1), ("x", None, "block", 1)], "host string, path string, verdict string, key int")
    stated = [*URL_RULES, ("b.a.net", "/es/", "allow"), ("x", "", "block")]
    got = match_rules(df, rules, sweeps=3).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((str(r.page_id), *[str(x) if k == 2 else x for k, x in enumerate(brute(r.url, stated))]) for r in df.collect())
    assert match_rules(df.limit(0), rules).count() == 0
    assert {r.verdict for r in match_rules(df, rules.limit(0), default="block").collect()} == {"block"}


def test_registered_sql_covers_both():
    assert {"op4_url_filter", "op8_exact_dedup"} <= oracle_sql().keys()
