"""Readers and writers with explicit schemas; text splits across tasks as Spark's readers do it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- graphs


def read_edges(spark: SparkSession, path: str, directed: bool = True, weighted: bool = True, comment: str = "#", n: int | None = None) -> DataFrame:
    """``(src, dst, weight)`` of whitespace-separated lines; malformed and blank lines and comments are skipped.

    Unweighted edges get weight 1. n: drop edges with an end outside 0..n-1. Undirected: both directions.
    """
    parts = F.split(F.trim("value"), r"\s+")
    need = 3 if weighted else 2
    number = lambda k: F.expr(f"try_cast(_p[{k}] as bigint)")
    lines = spark.read.text(path).where(~F.trim("value").startswith(comment)).select(parts.alias("_p")).where(F.size("_p") >= need)
    out = lines.select(number(0).alias("src"), number(1).alias("dst"), (number(2) if weighted else F.lit(1).cast("long")).alias("weight")).where("src is not null and dst is not null and weight is not null")
    if n is not None:
        out = out.where(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
    if not directed:
        out = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return out


def inline_edges(spark: SparkSession, edges: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(int(e[0]), int(e[1]), int(e[2]) if len(e) > 2 else 1) for e in edges], "src long, dst long, weight long")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.mode("overwrite").text(path)


def write_distances(dist: DataFrame, path: str, header: str = "Shortest distances") -> None:
    """A header line, then ``To v: d`` or ``To v: INF`` in order of vertex, over as many part files as there are ranges."""
    lines = dist.select(F.col("vertex").cast("long").alias("k"), F.format_string("To %d: %s", F.col("vertex"), F.coalesce(F.col("dist").cast("string"), F.lit("INF"))).alias("value"))
    head = dist.sparkSession.createDataFrame([(-1, header)], "k long, value string")
    head.unionByName(lines).orderBy("k").select("value").write.mode("overwrite").text(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").rlike(r"^To \d+: "))
    got = F.regexp_extract("value", r"^To (\d+): (\S+)", 2)
    return lines.select(F.regexp_extract("value", r"^To (\d+):", 1).cast("long").alias("vertex"), F.when(got != "INF", got.cast("long")).alias("dist"))


# ---- features, labels, predictions


def read_features(spark: SparkSession, path: str, columns: list[str], header: bool = True, label: str | None = None) -> DataFrame:
    """``(features[, label])`` of a CSV of doubles with the given columns; one of them may be the label."""
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == label else T.DoubleType()) for c in columns])
    rows = spark.read.schema(schema).option("header", header).option("mode", "DROPMALFORMED").csv(path)
    out = [F.array(*[F.col(c) for c in columns if c != label]).alias("features")]
    return rows.select(*out, *([F.col(label).alias("label")] if label else []))


def write_features(points: DataFrame, path: str, d: int) -> None:
    """id, then x,y for two dimensions or feature_0, feature_1, ..."""
    names = ["x", "y"] if d == 2 else [f"feature_{i}" for i in range(d)]
    points.select("id", *[F.get("features", i).alias(c) for i, c in enumerate(names)]).write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, label int").option("header", True).csv(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.select("id", "label").write.mode("overwrite").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select(F.col("id").alias("index"), F.col("pred").alias("predicted_cluster")).write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("index long, predicted_cluster int").option("header", True).csv(path)


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- models and traces


def joined_numbers(values: Column) -> Column:
    return F.concat_ws(" ", F.transform(values, lambda v: v.cast("string")))


def parsed_numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.cast("double"))


def model_lines(model: DataFrame) -> DataFrame:
    """Component, Weight, Mean, Covariance with arrays joined by spaces, covariances row by row."""
    return model.select(F.col("component").alias("Component"), F.col("weight").alias("Weight"), joined_numbers(F.col("mean")).alias("Mean"), joined_numbers(F.flatten("cov")).alias("Covariance"))


def model_of_lines(lines: DataFrame) -> DataFrame:
    d = F.size("mean")
    flat = lines.select(F.col("Component").cast("int").alias("component"), F.col("Weight").cast("double").alias("weight"), parsed_numbers(F.col("Mean")).alias("mean"), parsed_numbers(F.col("Covariance")).alias("_flat"))
    return flat.select("component", "weight", "mean", F.transform(F.sequence(F.lit(0), d - 1), lambda r: F.slice("_flat", r * d + 1, d)).alias("cov"))


def write_model(model: DataFrame, path: str) -> None:
    model_lines(model).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return model_of_lines(spark.read.schema("Component int, Weight double, Mean string, Covariance string").option("header", True).csv(path))


def write_trace(trace: DataFrame, path: str) -> None:
    trace.select("iteration", "log_likelihood").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("iteration int, log_likelihood double").option("header", True).csv(path)


# ---- timing reports

# Fixed value: a number with an optional exponent.
NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"


def timing_lines(text: DataFrame) -> DataFrame:
    """``(stage, seconds, pct)`` of lines ``label: value seconds (pct%)`` in a column ``value``."""
    label = F.trim(F.regexp_extract("value", r"^([^:]+):", 1))
    seconds = F.regexp_extract("value", rf":\s*({NUMBER})\s*(?:s|seconds)\b", 1)
    pct = F.regexp_extract("value", rf"\(\s*({NUMBER})\s*%", 1)
    return text.select(label.alias("stage"), F.when(seconds != "", seconds).cast("double").alias("seconds"), F.when(pct != "", pct).cast("double").alias("pct")).where("stage <> '' and seconds is not null")


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    return timing_lines(spark.read.text(path))


def write_timing(summary: DataFrame, path: str) -> None:
    """The report that ``read_timing`` reads, of ``(stage, total, pct)``."""
    summary.select(F.format_string("%s: %s seconds (%s%%)", "stage", F.col("total").cast("string"), F.col("pct").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_rank_log(timings: DataFrame, path: str) -> None:
    timings.select("procs", "run", "rank", "seconds").write.mode("append").option("header", False).csv(path)


def read_rank_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("procs int, run int, rank int, seconds double").csv(path)


# Fixed value: the line that ends a block of a timing log.
BLOCK_END = "-" * 44


def write_rank_blocks(timings: DataFrame, path: str) -> None:
    """A block of text for each run of ``(procs, run, rank, seconds)``: a line per process, their maximum and mean."""
    line = F.format_string(" Process %d: %s seconds", F.col("r.rank"), F.col("r.seconds").cast("string"))
    rows = timings.select("procs", "run", F.struct("rank", "seconds").alias("r"), line.alias("line"))
    runs = rows.groupBy("procs", "run").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("lines"), F.max("r.seconds").alias("most"), F.avg("r.seconds").alias("mean"))
    head = F.format_string("Execution with %d processors", F.col("procs"))
    tail = F.format_string("Maximum Time: %s seconds\nAverage Time Per Process: %s seconds\n", F.col("most").cast("string"), F.col("mean").cast("string"))
    text = F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda v: v["line"]), "\n"), tail)
    runs.select(text.alias("value")).write.mode("append").option("lineSep", f"{BLOCK_END}\n").text(path)


def read_rank_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(procs, run, rank, seconds)`` of such a log: a record is a block, so long files split; run numbers tell blocks apart, with gaps."""
    blocks = spark.read.option("lineSep", BLOCK_END).text(path).select(F.regexp_extract("value", r"Execution with (\d+) processors", 1).alias("procs"), "value").where("procs <> ''")
    line = rf"Process (\d+):\s*({NUMBER})\s*seconds"
    part = lambda k: F.regexp_extract_all("value", F.lit(line), F.lit(k))
    rows = blocks.select(F.col("procs").cast("int").alias("procs"), F.monotonically_increasing_id().alias("run"), F.arrays_zip(part(1).alias("rank"), part(2).alias("seconds")).alias("rows"))
    return rows.select("procs", "run", F.explode("rows").alias("r")).select("procs", "run", F.col("r.rank").cast("int").alias("rank"), F.col("r.seconds").cast("double").alias("seconds"))


def report_lines(metrics: DataFrame, buckets: DataFrame) -> DataFrame:
    """Lines of a performance report, of ``(metric, value, unit)`` and ``(bucket, size, seconds)``."""
    one = metrics.select(F.rtrim(F.format_string("  %s: %s %s", "metric", F.col("value").cast("string"), F.coalesce("unit", F.lit("")))).alias("value"))
    return one.unionByName(buckets.select(F.format_string("  %d | %d | %s", "bucket", "size", F.col("seconds").cast("string")).alias("value")))


def write_report(metrics: DataFrame, buckets: DataFrame, path: str) -> None:
    report_lines(metrics, buckets).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(metric, value, unit)`` and ``(bucket, size, seconds)`` of a performance report; other lines are skipped."""
    lines = spark.read.text(path)
    metric = rf"^\s*([^:|]+):\s*({NUMBER})\s*(\S*)\s*$"
    bucket = rf"^\s*(\d+)\s*\|\s*(\d+)\s*\|\s*({NUMBER})\s*$"
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    metrics = lines.where(F.col("value").rlike(metric)).select(F.trim(part(metric, 1)).alias("metric"), part(metric, 2).cast("double").alias("value"), part(metric, 3).alias("unit"))
    buckets = lines.where(F.col("value").rlike(bucket)).select(part(bucket, 1).cast("long").alias("bucket"), part(bucket, 2).cast("long").alias("size"), part(bucket, 3).cast("double").alias("seconds"))
    return metrics, buckets


def read_delta_timings(spark: SparkSession, path: str) -> DataFrame:
    """Seconds of runs by bucket width, of a CSV with a header and the columns in this order."""
    return spark.read.schema("delta long, total double, kernel double, transfer double, buckets double, iterations int, result string").option("header", True).csv(path)


def write_messages(messages: DataFrame, path: str) -> None:
    """``(rank, value)`` in order of rank, as one file (a row per rank)."""
    messages.orderBy("rank").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_messages(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Lines in file order, or with ``length`` the slices of that many characters that ranks would read."""
    whole = spark.read.text(path, wholetext=True)
    if length is None:
        return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("rank", "value"))
    ranks = F.sequence(F.lit(0), F.ceil(F.length("value") / length).cast("int") - 1)
    return whole.select("value", F.explode(ranks).alias("rank")).select("rank", F.substring("value", F.col("rank") * length + 1, F.lit(length)).alias("value"))
