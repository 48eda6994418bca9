"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Every (record key, shard) pair gets a pseudo-random score; a record goes to its highest score.
A new shard can only win records for itself, so nothing moves between the old shards.

Defined results: a null key is replaced by a hash of the record's payload columns, so null keys spread
over all shards; equal keys always share a shard; an empty table gives an empty result; other columns
of the input pass through, and a clash with a result column is an error of the caller (``out=`` renames it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read

#: 2 ** 53: scores use the top 53 bits of the hash, exact as doubles.
_UNIT = float(1 << 53)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based int) that wins ``key``; a shard's share of keys is its share of the weights."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")

    def score(shard: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(_UNIT)
        return F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(-shard).alias("minus"))

    return (-F.array_max(F.array(*[score(s, w) for s, w in enumerate(weights)]))["minus"]).cast("int")


def record_key(key: Column, *payload: Column) -> Column:
    """A hash of ``key``; of the payload where the key is null."""
    return F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("no key"), *payload))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], n_rows: int, rows_per_run: int = 1 << 16, out: str = "slot") -> DataFrame:
    """Number each shard's rows 0, 1, 2, ... without gaps and without sorting a whole shard in one task.

    Rows are split by a hash of ``order`` into runs of about ``rows_per_run``; a run is numbered by itself and
    starts after the runs before it. Only one small row per run is summed up shard by shard.
    """
    runs = max(1, -(-n_rows // rows_per_run))
    run = F.pmod(F.xxhash64(F.lit("run"), *[F.col(c) for c in order]), F.lit(runs))
    dealt = df.withColumn("_run", run)
    counts = dealt.groupBy(shard, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_run").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(within).cast("long") - 1)
    return numbered.join(starts, [shard, "_run"]).withColumn(out, F.col("_start") + F.col("_at")).drop("_run", "_at", "_start")


def shard_table(df: DataFrame, key: str, payload: Sequence[str], weights: Sequence[float], grown: float | None = None, rows_per_run: int = 1 << 16) -> DataFrame:
    """Add ``shard``, ``slot`` and, where ``grown`` is the weight of one more shard, ``grown_shard``."""
    hashed = record_key(F.col(key), *[F.col(c) for c in payload])
    dealt = df.withColumn("shard", rendezvous(hashed, weights))
    dealt = dealt.withColumn("grown_shard", rendezvous(hashed, [*weights, grown]) if grown else F.lit(None).cast("int"))
    return with_slots(dealt, "shard", [key, *payload], df.count(), rows_per_run)


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard are spread over tasks, so a large shard is many files."""
    df.write.partitionBy("shard").mode("overwrite").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    out = shard_table(rows, "doc_id", ["text_crc32", "size"], [1.0] * 8, grown=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
