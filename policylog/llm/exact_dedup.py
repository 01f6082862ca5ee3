"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by byte length, the survivors by a hash of a short prefix, and only rows that are still in a group of two
or more have their whole text hashed. What survives a level reaches the next scan as a bitmap of hashes of fixed size: it is
broadcast at any number of groups, and a collision only means that a text is hashed which need not be. No text is ever
shuffled: what moves between tasks are ids, lengths and hashes, and every grouping combines on the map side, so a group of
copies that holds a third of all rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylog.llm.common import attach_groups, hash_filter, may_be_in, one_row_each, settle, text_or_empty, without_rows


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digests: bool) -> DataFrame:
    """doc_id, n_bytes, full_hash (null where a level proved the text unique), and text_sha256 of every text if asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    lengths = rows.groupBy("n_bytes").count().where("count > 1")
    rows = may_be_in(rows, F.col("n_bytes"), settle(hash_filter(F.col("n_bytes"), lengths)), "_same_length")
    rows = rows.withColumn("_prefix", F.when(F.col("_same_length"), F.xxhash64("n_bytes", F.substring("_text", 1, prefix_chars))))
    prefixes = rows.where("_prefix is not null").groupBy("_prefix").count().where("count > 1")
    rows = may_be_in(rows, F.col("_prefix"), settle(hash_filter(F.col("_prefix"), prefixes)), "_same_prefix")
    full = F.when(F.col("_same_prefix"), F.sha2("_text", 256)).alias("full_hash")
    every = [F.sha2("_text", 256).alias("text_sha256")] if digests else []
    return settle(rows.select("doc_id", "n_bytes", full, *every))


def _counted(refined: DataFrame) -> DataFrame:
    return refined.where("full_hash is not null").groupBy("full_hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _groups(counted: DataFrame) -> DataFrame:
    sizes = counted.groupBy("full_hash").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return sizes.where("group_size > 1")


def _marked(refined: DataFrame, groups: DataFrame) -> DataFrame:
    found = attach_groups(refined, groups, "full_hash", "group_size")
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    found = found.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, full_hash, keep_id, group_size, kept, and with digests text_sha256.

    A null text counts as empty, and empty texts equal each other. The row with the largest id of equal texts stays; a null
    id is smaller than any. full_hash (SHA-256) is null where an earlier level already proved the text unique; text_sha256
    is there for every row. Rows that repeat both id and text can't be told apart: all rows with the kept id are marked kept.
    Rows that share an id but not the text are judged each by its own. An empty table gives no rows. Other columns of docs
    are ignored.
    """
    refined = _refined(docs, id_col, text_col, prefix_chars, digests)
    return _marked(refined, _groups(_counted(refined)))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """docs with exactly one row of each group of equal texts, one with the largest id (null only if the group has no other);
    all columns stay. Of rows that repeat both id and text one stays, whichever the cluster meets first."""
    refined = _refined(docs, id_col, text_col, prefix_chars, False)
    counted = settle(_counted(refined))
    marked = _marked(refined, _groups(counted))
    digest = F.sha2(text_or_empty(text_col), 256)
    dropped = settle(marked.where("not kept").select("doc_id", F.col("full_hash").alias("digest")).distinct())
    repeated = counted.where("n > 1").select("doc_id", F.col("full_hash").alias("digest"))
    return one_row_each(without_rows(docs, id_col, digest, dropped), id_col, digest, repeated)
