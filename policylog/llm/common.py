"""Shared helpers: table access, durable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a hash filter, and of one row of it: at most 4,096 rows of 4 KB are broadcast, whatever the number of keys.
FILTER_BITS, _ROW_BITS = 1 << 27, 1 << 15
#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 8 << 20
#: Groups that hold more than this share of all rows are hot; there are fewer than its inverse.
HOT_SHARE = 0.001


def small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH_BYTES of rows at a time, unless the session asks for less: a batch is held by the JVM and by
    the worker, and two tasks of long texts side by side would else take hundreds of MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="policylog-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    small_batches(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor: the deterministic held-out split."""
    return F.pmod(F.crc32(F.col(name).cast("string")), F.lit(divisor))


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no column is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_filter(hashes: Column, keys: DataFrame) -> DataFrame:
    """The hashes of keys as bitmaps of fixed total size: rows (_row, _bits), made for :func:`may_be_in`."""
    at = F.pmod(hashes, F.lit(FILTER_BITS))
    rows = keys.where(hashes.isNotNull()).select((at / _ROW_BITS).cast("long").alias("_row"), (at % _ROW_BITS).alias("_at"))
    return rows.groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def may_be_in(df: DataFrame, hashes: Column, made: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: false only for rows whose hash is surely not among the filter's keys. The filter is bounded
    by FILTER_BITS, so it is broadcast at any size; the more keys, the more rows pass that need not."""
    at, row, bits = (fresh(n, df) for n in ("_hash_at", "_hash_row", "_hash_bits"))
    found = df.withColumn(at, F.pmod(hashes, F.lit(FILTER_BITS)))
    made = F.broadcast(made.select(F.col("_row").alias(row), F.col("_bits").alias(bits)))
    found = found.join(made, (F.col(at) / _ROW_BITS).cast("long") == F.col(row), "left")
    place = f"cast(`{at}` % {_ROW_BITS} as int)"
    byte = f"cast(conv(hex(substring(`{bits}`, {place} div 8 + 1, 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"(shiftright({byte}, {place} % 8) & 1) = 1"), F.lit(False))
    return found.select(*df.columns, hit.alias(name))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the other columns of their group in groups (distinct key, and size: its rows), null where there is none.

    The hot groups, fewer than 1 / HOT_SHARE, are broadcast; rows of these, and rows without key, are dealt out evenly in the
    shuffle that brings the rest to their groups. So no task gets a hot group's rows.
    """
    groups = settle(groups)
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total * HOT_SHARE
    values = [c for c in groups.columns if c != key]
    first = groups.where(hot).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = groups.where(~hot).select(F.col(key).alias("_rest_key"), F.lit(0).cast("long").alias("_rest_salt"), *[F.col(c).alias(f"_rest_{c}") for c in values])
    met = rows.join(F.broadcast(first), F.col(key) == F.col("_hot_key"), "left")
    met = met.withColumn("_salt", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    met = met.join(rest, (F.col(key) == F.col("_rest_key")) & (F.col("_salt") == F.col("_rest_salt")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values])


def without_rows(docs: DataFrame, id_col: str, digest: Column, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id and digest are those of a row (doc_id, digest) of dropped; nulls equal nulls. Only rows
    whose id may be among the dropped are moved, so texts that stay are not shuffled."""
    ident, flag, own = F.col(id_col), fresh("_may_go", docs), fresh("_digest", docs)
    flagged = may_be_in(docs, F.xxhash64(ident), hash_filter(F.xxhash64("doc_id"), dropped), flag)
    asked = flagged.where(F.col(flag)).withColumn(own, digest)
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest"))
    stay = asked.join(gone, asked[id_col].eqNullSafe(gone["_gone_id"]) & (asked[own] == gone["_gone_digest"]), "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(stay.select(*docs.columns))


def one_row_each(docs: DataFrame, id_col: str, digest: Column, repeated: DataFrame) -> DataFrame:
    """docs with one row for each id and digest of repeated (doc_id, digest; rows that occur more than once)."""
    if repeated.isEmpty():
        return docs
    own = fresh("_digest", docs)
    marked = docs.withColumn(own, digest)
    again = repeated.select(F.col("doc_id").alias("_again_id"), F.col("digest").alias("_again_digest"))
    same = marked[id_col].eqNullSafe(again["_again_id"]) & (marked[own] == again["_again_digest"])
    once = marked.join(again, same, "left_semi").dropDuplicates([id_col, own])
    return marked.join(again, same, "left_anti").unionByName(once).select(*docs.columns)


#: What empties a Python worker's caches. Workers are reused from stage to stage, and what one operator has cached would
#: stand in the way of the next one's memory.
CACHES: dict[str, Callable[[], bool]] = {}


def release_caches(keep: str | None = None) -> None:
    """Called on a worker by operators that need no cache of another's, only their own. Freed memory goes back to the system, as the JVM
    beside the worker shares its limit."""
    if any([empty() for name, empty in CACHES.items() if name != keep]):
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: freed memory stays with the process
