import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as tx


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.25
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(2, 6) if bad else rng.random() < 0.05):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "grrA", "grrB", "grr%d" % rng.randrange(99)])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy(spark):
    data = rows(900, 1)
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    out = tx.toxicity(df.withColumn("score", F.lit(3)), df, ~tx.held_out(F.col("doc_id")))
    scores = {r["doc_id"]: r["score"] for r in out.collect()}
    held = {r[0] for r in df.where(tx.held_out(F.col("doc_id"))).select("doc_id").collect()}
    right = np.mean([(scores[i] >= 0.5) == bool(t) for i, _, t in data if i in held])
    assert 0.15 < len(held) / 900 < 0.35 and right > 0.93


def brute(docs, labels, learn, per_class, nearest):
    """Scores from the definition, with dictionaries."""
    import math
    import re
    from collections import Counter

    def terms(text):
        words = [w.encode() for w in re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())]
        return Counter(words + [w[: tx.BEGINNING] + b"-" for w in words if len(w) > tx.BEGINNING])

    known = {}
    for i, y in labels:
        if i is not None and y is not None and learn(i):
            known[i] = max(known.get(i, 0), y)
    share = sum(known.values()) / len(known)
    examples = list({(i, known[i], t) for i, t in docs if i in known and t})
    n1 = sum(e[1] for e in examples)
    n0 = len(examples) - n1
    assert n1 <= per_class >= n0  # all are in the sample
    vectors = [terms(t) for _, _, t in examples]
    df = Counter(t for _, text in docs for t in terms(text))
    weight = {}
    for t in {t for v in vectors for t in v}:
        c1 = sum(t in v for v, e in zip(vectors, examples, strict=True) if e[1])
        c0 = sum(t in v for v, e in zip(vectors, examples, strict=True) if not e[1])
        z2 = (c1 / n1 - c0 / n0) ** 2 / ((c0 + c1 + 1) / (n0 + n1) * (1 / n0 + 1 / n1))
        weight[t] = math.log((2 + len(docs)) / (1 + df[t])) * z2
    unit = lambda v: (lambda w, n: {t: x / n for t, x in w.items()})(w := {t: (1 + math.log(k)) * weight[t] for t, k in v.items() if t in weight}, math.sqrt(sum(x * x for x in w.values())) or 1)
    units = [unit(v) for v in vectors]
    out = []
    for _, text in docs:
        q = unit(terms(text))
        found = [(round(sum(x * u.get(t, 0) for t, x in q.items()), 9), y) for u, (_, y, t0) in zip(units, examples, strict=True) if t0 != text]
        floor = sorted((c for c, _ in found), reverse=True)[nearest - 1]
        one = ((1 - share) / n0 + share / n1) / 2
        top, bottom = share * one, one
        for c, y in found:
            if c >= floor and c > 0:
                w = c / (1 - min(c, 1) + 0.02)
                top += w * y * share / n1
                bottom += w * (share / n1 if y else (1 - share) / n0)
        out.append(top / bottom)
    return out


def test_scores_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(tx, "PAIRS", 5000)
    monkeypatch.setattr(tx.BlockMaxIndex, "BLOCK", 8)
    monkeypatch.setattr(tx.BlockMaxIndex, "FREQUENT", 0.3)
    data = rows(260, 4)
    docs = [(i, t) for i, t, _ in data] + [(3, data[5][1]), (3, "another IDIOT text"), (900, data[9][1]), (901, data[9][1]), (None, "Scum É ß"), (902, "...")]
    labels = [(i, y) for i, _, y in data] + [(1, 1), (1, 0), (None, 1), (2, None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, score long, toxic string").repartition(3)
    got = tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.pmod("doc_id", F.lit(3)) > 0, per_class=300, nearest=7)
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["score"]) for r in got.collect())
    want = sorted(((i is None, i or 0), s) for (i, _), s in zip(docs, brute(docs, labels, lambda i: i % 3 > 0, 300, 7), strict=True))
    assert [k for k, _ in have] == [k for k, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(have, want, strict=True)) < 1e-5


def test_few_labels_still_teach(spark):
    clean = [(i, f"plain words number {i} here") for i in range(30)]
    docs = [*clean, (100, "you idiot scum"), (101, "idiot and scum again"), (102, "such scum idiot"), (103, "an idiot scum text"), (104, "plain words here")]
    labels = [(i, 0) for i, _ in clean] + [(100, 1), (101, 1), (102, 1)]
    out = tx.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    assert score[103] > 0.5 > 0.3 > score[104]


def test_a_long_text(spark):
    rng = random.Random(1)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(700_000)) + " idiot"
    docs = spark.createDataFrame([(i, f"word{i} fine") for i in range(20)] + [(50, "idiot a"), (51, "idiot b"), (52, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 50)) for i in [*range(20), 50, 51]], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels, F.lit(True)).collect()}
    assert score[52] > 0.5


def test_nulls_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "..."), (3, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 for r in got)
    assert all(r["score"] == 0.0 for r in tx.toxicity(docs, labels.limit(0), F.lit(True)).collect())
    assert tx.toxicity(docs.limit(0), labels, F.lit(True)).count() == 0
