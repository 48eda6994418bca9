import hashlib

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

PIECES = st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|", "\n", "a", "é", "<\\s>", "ok"])
TEXTS = st.lists(PIECES, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXTS), TEXTS), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("<|im_start|>") == len(turns) == formatted.count("<|im_end|>")
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_paths_of_a_tree(spark):
    rows = [
        (1, 0, None, 1.0), (1, 1, 0, 5.0), (1, 2, 0, 1.0), (1, 3, 1, 1.0), (1, 4, 1, 9.0),  # two branches below 1
        (2, 7, 99, 1.0), (2, 8, 7, 1.0),  # the parent is missing
        (3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 2, 1.0), (3, 4, None, 1.0),  # a cycle, and one below it
        (None, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    paths = {}
    for r in chat.tree_paths(df).collect():
        paths.setdefault((r["conv_id"], r["rank"]), []).append((r["depth"], r["node"]))
    got = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert got == {(1, 1): [0, 1, 4], (1, 2): [0, 1, 3], (1, 3): [0, 2], (2, 1): [7, 8], (3, 1): [4], (None, 1): [0]}
    best = chat.tree_paths(df, keep=1).where("conv_id = 1").collect()
    assert sorted(r["node"] for r in best) == [0, 1, 4]


@pytest.mark.parametrize("n", [1, 9, 40])
def test_long_chains(spark, n):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), (F.lit(n) - F.col("id")).alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"), F.lit(9).alias("node"))
    tree = chat.chain(rows, "conv_id", ["turn"]).withColumn("score", F.lit(0.0))
    got = chat.format_paths(chat.tree_paths(tree), tree).collect()
    assert len(got) == 1 and got[0]["n_turns"] == n
    want = "".join(str(i) for i in reversed(range(n)))
    assert got[0]["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[0]["loss_chars"] == len(want)


def test_nulls_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "")]
    tree = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", ["turn", "role", "text"]).withColumn("score", F.lit(0.0))
    got = {r["conv_id"]: r for r in chat.format_paths(chat.tree_paths(tree), tree).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\n\nx\n").hexdigest()
    assert chat.format_paths(chat.tree_paths(tree.limit(0)), tree.limit(0)).count() == 0
