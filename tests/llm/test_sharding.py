from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding


def table(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("size"))


def test_shares_follow_weights_and_growth_only_feeds_the_new_shard(spark):
    rows = sharding.shard_table(table(spark, 8000), "doc_id", ["size"], [1.0, 1.0, 2.0], grown=1.0, rows_per_run=500).collect()
    share = Counter(r["shard"] for r in rows)
    assert abs(share[2] / 8000 - 0.5) < 0.03 and abs(share[0] / 8000 - 0.25) < 0.03
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {3} and abs(len(moved) / 8000 - 0.2) < 0.03
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_law_against_the_definition(spark):
    rows = sharding.shard_table(table(spark, 200), "doc_id", ["size"], [1.0] * 8).collect()

    def spark_hash(value, seed, width):
        return xxhash.xxh64(value.to_bytes(width, "little", signed=True), seed=seed).intdigest()

    for r in rows:
        key = spark_hash(r["doc_id"], 42, 8)
        signed = key - (1 << 64) if key >> 63 else key
        best = max(range(8), key=lambda s: (spark_hash(s, spark_hash(signed, 42, 8), 4) >> 11, -s))
        assert r["shard"] == best


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, 1, 9), (None, 2, 9), (5, 1, 9), (5, 1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard int")
    got = sharding.shard_table(df, "doc_id", ["size"], [1.0] * 8).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == 4
    assert sharding.shard_table(df.limit(0), "doc_id", ["size"], [1.0] * 8).count() == 0


def test_files(spark, tmp_path):
    sharding.write_shards(sharding.shard_table(table(spark, 300), "doc_id", ["size"], [1.0] * 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3
