import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring_dedup as sd
from tessera.llm.suffix_arrays import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repetitive_texts():
    for text in (b"a" * 500, b"ab" * 250, b"abaab" * 60, bytes(range(256)) * 2, b"mississippi" * 9):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            if g in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(g)
        kept = bytes(x for x, r in zip(b, gone, strict=True) if not r)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=70):
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choice("abcdefgh é\n") for _ in range(m))
    parts = [text(m) for m in (40, 90, 99, 100, 101, 130, 180, 400)] + ["x" * 350, "ab" * 120]
    out = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else text(rng.choice([0, 1, 30, 200])) for _ in range(rng.randrange(6)))) for i in range(n)]
    return out + [(n, out[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "é" * 50), (n + 4, "zé" + "é" * 49)]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "ARRAY_BYTES", 3000)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, doc int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in sd.dedup(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_carried_columns_and_empty_tables(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([(1, t, "p"), (1, t, "q"), (None, t, "r"), (2, None, None)], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"] or 9, r["n_removed"], r["kept"], r["lang"]) for r in sd.dedup(df, kept_text=True, carry=["lang"]).collect()), key=repr)
    assert got == [(1, 0, t, "p"), (1, 0, t, "q"), (2, 0, "", None), (9, 150, "", "r")]
    same = spark.createDataFrame([(1, "d" * 150), (1, "d" * 150)], "doc_id long, text string")
    assert [r["n_removed"] for r in sd.dedup(same).collect()] == [149, 149]
    assert sd.dedup(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcdefgh") for _ in range(150))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (None, c), (None, b + c)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"] or 9, r["n_bytes"], r["n_removed"]) for r in sd.dedup(df).collect())
        assert got == [(1, 150, 0), (2, 150, 0), (2, 150, 150), (3, 150, 150), (4, 150, 0), (9, 150, 150), (9, 300, 300)]


def test_frequent_anchor_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(sd, "MET", 2)
    monkeypatch.setattr(sd, "BLOCK", 6)
    monkeypatch.setattr(sd, "SENT", 0)
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(260)] = "Z"
        rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r[0]: tuple(r)[1:] for r in sd.dedup(df).collect()} == brute(rows)


def test_a_long_text(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000)) * 2
    df = spark.createDataFrame([(1, long), (2, long[1000:5000])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in sd.dedup(df).collect()} == {1: 2_500_000, 2: 4000}
