import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_clean_documents_and_catch_the_rest(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + "%x" % rng.randrange(1 << 30) for _ in range(n)]
    item = words(30)
    passage = words(60)
    docs = {i: words(120) for i in range(80)}
    docs[80] = list(docs[5])  # exact copy
    docs[81] = [*docs[6][:119], "changed"]  # near copy
    docs[82] = words(20) + item + words(20)  # leak
    docs[83] = words(50) + passage + words(30)
    docs[84] = words(50) + passage + words(30)  # the passage goes
    toxic = list(range(60, 80))
    for i in toxic:
        for w in ("idiot", "scum", "moron"):
            docs[i][rng.randrange(120)] = w
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == (set(range(60)) | {83, 84, 200, 201})
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = library.encode(" ".join(docs[7]), add_special_tokens=False).ids
    assert got[7]["ids"] == want and got[7]["n_tokens"] == len(want)
    assert got[84]["n_tokens"] < 0.7 * got[83]["n_tokens"] and got[200]["n_tokens"] == 0


def test_toxic_stage_uses_the_operators_threshold_and_each_rows_own_score(spark, tmp_path, monkeypatch):
    docs = [(1, "t"), (2, "clean"), (2, "t"), (None, "t"), (None, "clean"), (None, None), (3, None)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = F.when(F.col("text") == "t", 0.4).otherwise(0.1)
    monkeypatch.setattr(corpus_pipeline, "toxicity", lambda d, *_, key=None: d.select("doc_id", *([key] if key else []), score.alias("score")))
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.without_toxic(spark, df, str(tmp_path)).collect())
    assert got == Counter([(2, "clean"), (None, "clean"), (None, None), (3, None)])


def test_null_ids_are_scored_and_dropped(spark, tmp_path):
    rng = random.Random(5)
    words = lambda bad: " ".join([*(rng.choice("abcdefghij") + "%x" % rng.randrange(1 << 30) for _ in range(40)), *(["idiot", "scum", "moron"] if bad else [])])
    rows = [(i, words(i >= 60)) for i in range(80)] + [(None, words(True)), (None, words(False))]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.without_toxic(spark, df, str(tmp_path)).collect()}
    assert got == {*rows[:60], rows[81]}


def test_other_columns_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    clash = "doc_id long, text string, score string, key string, component string, kept string, leaked string, ids string"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), *"abcdef") for i in range(6)]
    spark.createDataFrame(rows, clash).write.parquet(f"{d}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(range(6))
    spark.createDataFrame([], clash).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    spark.catalog.clearCache()
    assert corpus_pipeline.run(spark, d).count() == 0
