"""Benchmark decontamination by spaced seeds (DataFrame functions only).

Texts and benchmark items are words (runs of letters or digits, lower-cased). A document is leaked when some alignment
of it with an item has a window of ``WINDOW`` words (the whole item where it is shorter) in which all words but a few
are equal: ``TOLERANCE`` substitutions by window length. Two fixed masks of five positions pick words at every place of
item and document and hash them; equal hashes are hits, and around each hit the alignment is verified word by word.
The masks find every alignment within the tolerance (``tests/llm`` proves it by enumeration), so nothing is missed.

A document's hashes are made, probed and verified inside one scan while the seeds of the benchmark are small enough
to broadcast (``broadcast_bytes``, checked); beyond that they meet in an exchange. Only verified alignments are summed.

Defined results: null and empty texts, and documents of fewer than five words, leak nothing; items of fewer than five
words are evidence of nothing; a row is judged by its own text, whatever other rows have its key, and rows without a
key too; repeated rows each get their row; texts of any length count whole; among equal alignments the smallest item is
named; columns of docs with the names of results are replaced; empty tables give no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

# The masks (positions that count) and the substitutions they cover, by least window length.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
TOLERANCE = {5: 0, 8: 1, 12: 2, 15: 3}
WINDOW = 16
LEAST = 5

WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _seeds(words: Column, at: Column, n: Column) -> Column:
    """The hash of each mask at the 0-based place ``at``; null where the mask sticks out."""
    return F.array(*[F.when(at + mask[-1] < n, F.xxhash64(F.lit(k), *[F.get(words, at + o) for o in mask])) for k, mask in enumerate(MASKS)])


def _allowed(window: Column) -> Column:
    out = F.lit(None).cast("int")
    for least, subs in TOLERANCE.items():
        out = F.when(window >= least, subs).otherwise(out)
    return out


def places(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, words, at, seed) per mask and place of every row with ``words``."""
    # the array of words is made once per text; its places and seeds are generated inside the same stage
    at = df.withColumn("n_words", F.size("words")).where(F.col("n_words") >= LEAST).select(*keys, "words", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words") - LEAST)).alias("at"))
    seeds = at.select(*keys, "words", "at", F.explode(_seeds(F.col("words"), F.col("at"), F.col("n_words"))).alias("seed"))
    return seeds.where("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Verified ``(doc_key, item_id, share, n)``: the best window's share of equal words, for rows of ``(doc_key, text)``."""
    items = benchmark.where("text is not null").select("item_id", word_hashes(F.col("text")).alias("words"))
    seeds = places(items, ["item_id"]).select("seed", "item_id", F.col("words").alias("item"), F.col("at").alias("q"))
    mine = places(docs.select("doc_key", word_hashes(F.col("text")).alias("words")), ["doc_key"])
    shift = (F.col("at") - F.col("q")).alias("shift")
    size = seeds.agg(F.sum(8 * F.size("item") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        hits = mine.join(F.broadcast(seeds), "seed").select("doc_key", "item_id", "item", "words", shift)
    else:
        met = mine.select("doc_key", "seed", "at").join(seeds.select("seed", "item_id", "q"), "seed").select("doc_key", "item_id", shift).distinct()
        texts = docs.select("doc_key", word_hashes(F.col("text")).alias("words"))
        hits = met.join(items.withColumnRenamed("words", "item"), "item_id").join(texts, "doc_key")
    # the document's words that face the item's are cut out at once (the generator keeps the optimiser from doing it
    # later), so that no hit carries its document along
    skip = F.greatest(-F.col("shift"), F.lit(0))
    part = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item") - skip)
    one = hits.select("doc_key", "item_id", F.explode(F.array(F.struct("item", skip.alias("skip"), part.alias("part")))).alias("h"))
    facing = F.transform("h.item", lambda w, i: F.when(i >= F.col("h.skip"), F.get(F.col("h.part"), i - F.col("h.skip"))))
    return verify(one.select("doc_key", "item_id", F.col("h.item").alias("item"), facing.alias("facing")))


def verify(hits: DataFrame) -> DataFrame:
    """Keep hits whose alignment has a window within the tolerance; one row per document and item, the best of them."""
    equal = hits.withColumn("same", F.zip_with("item", "facing", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))).withColumn("w", F.least(F.lit(WINDOW), F.size("item")))
    window = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("w")), F.lit(0), lambda a, x: a + x))
    best = equal.withColumn("best", F.array_max(window)).where(F.col("best") >= F.col("w") - _allowed(F.col("w")))
    return best.groupBy("doc_key", "item_id").agg(F.max(F.round(F.col("best") / F.col("w"), 6)).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``leaked``, ``n_items``, ``best_item`` and ``best_share``; one row for each row of docs."""
    docs = docs.drop("leaked", "n_items", "best_item", "best_share").withColumn("_h", F.xxhash64(text))
    found = leaks(docs.select(F.struct(F.col(key).alias("k"), F.col("_h").alias("h")).alias("doc_key"), F.col(text).alias("text")), benchmark)
    per_doc = found.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("share", (-F.col("item_id")).alias("minus"))).alias("top"))
    per_doc = per_doc.select(F.col("doc_key.k").alias("_k"), F.col("doc_key.h").alias("_g"), "n_items", (-F.col("top.minus")).alias("best_item"), F.col("top.share").alias("best_share"))
    out = docs.join(per_doc, docs[key].eqNullSafe(per_doc["_k"]) & (docs["_h"] == per_doc["_g"]), "left").drop("_k", "_g", "_h")
    return out.withColumn("leaked", F.col("n_items").isNotNull()).withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), "doc_id", "text").select("doc_id", "leaked", "n_items", "best_item", "best_share")


def _sql() -> str:
    masks = " UNION ALL ".join(f"SELECT d, n, pos, concat_ws(' ', {k}, {', '.join(f'w[pos + {o + 1}]' for o in m)}) AS seed FROM {{0}} WHERE pos + {m[-1]} < n" for k, m in enumerate(MASKS))
    allowed = "CASE " + " ".join(f"WHEN w >= {least} THEN {subs}" for least, subs in sorted(TOLERANCE.items(), reverse=True)) + " END"
    return f"""
    WITH dw AS (SELECT doc_id AS d, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
    iw AS (SELECT item_id AS d, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
    dp AS (SELECT d, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos FROM dw),
    ip AS (SELECT d, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos FROM iw),
    ds AS ({masks.format("dp")}),
    ins AS ({masks.format("ip")}),
    hits AS (SELECT DISTINCT ds.d AS doc_id, ins.d AS item_id, ds.pos - ins.pos AS shift FROM ds JOIN ins ON ds.seed = ins.seed),
    facing AS (SELECT h.doc_id, h.item_id, h.shift, least({WINDOW}, len(iw.w)) AS w,
        list_transform(range(0, len(iw.w)), lambda i: CASE WHEN h.shift + i >= 0 AND h.shift + i < len(dw.w) AND dw.w[h.shift + i + 1] = iw.w[i + 1] THEN 1 ELSE 0 END) AS same
        FROM hits h JOIN dw ON dw.d = h.doc_id JOIN iw ON iw.d = h.item_id),
    best AS (SELECT doc_id, item_id, w, list_max(list_transform(range(0, len(same) - w + 1), lambda i: list_sum(same[i + 1 : i + w]))) AS best FROM facing),
    good AS (SELECT doc_id, item_id, max(round(best / w, 6)) AS share FROM best WHERE best >= w - ({allowed}) GROUP BY ALL),
    per AS (SELECT doc_id, count(*) AS n, max(share) AS share FROM good GROUP BY 1),
    named AS (SELECT g.doc_id, min(g.item_id) AS item FROM good g JOIN per p ON g.doc_id = p.doc_id AND g.share = p.share GROUP BY 1)
    SELECT d.doc_id, p.n IS NOT NULL AS leaked, CAST(coalesce(p.n, 0) AS BIGINT) AS n_items, n.item AS best_item, p.share AS best_share
    FROM documents d LEFT JOIN per p USING (doc_id) LEFT JOIN named n USING (doc_id)
    """


SQL = _sql()
