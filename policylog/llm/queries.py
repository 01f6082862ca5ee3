"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.llm.common import crc_mod, settle, table

URL_RULES = [  # fixed values: host, path, verdict
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))  # a null id has no remainder: not learned from, not held out
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from policylog.llm.token_store import read_store, remove_store, write_store

    docs = table(spark, sf_dir, "documents")
    folder = write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), cut="leading", end_id=0)
    found = settle(read_store(docs, folder))
    remove_store(folder)
    return found


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.url_filter import match_rules

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    return match_rules(table(spark, sf_dir, "pages"), rules)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from policylog.llm.packing import packed_digests

    return packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cut="dropped", end_id=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from policylog.llm.token_counts import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "leading")
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.simhash import cluster

    found = cluster(table(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.exact_dedup import mark_duplicates

    return mark_duplicates(table(spark, sf_dir, "documents"), digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.pii import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_span_list(base), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policylog.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_store": op2_token_store,
        "op3_decontaminate": op3_decontaminate,
        "op4_url_filter": op4_url_filter,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_simhash": op7_simhash,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op4_url_filter": f"""
            WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
            cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            fits AS (SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rank
                     FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
            SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
            FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND rank = 1""",
        "op8_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
