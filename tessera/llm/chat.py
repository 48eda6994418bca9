"""Chat formatting of reply trees.

``tree_paths`` enumerates the root-to-leaf paths of message trees by iterative self-joins (pointer doubling: the
number of joins is the logarithm of the depth), ranks a conversation's branches by the mean score of their messages
and keeps the best; ``format_paths`` writes each path as one string with a loss mask; ``parse`` reads it back.

Template: ``<|im_start|>ROLE\nTEXT<|im_end|>\n`` per message. Control strings inside a text or role get a backslash
after their first character and backslashes are doubled, which ``unescape`` undoes exactly.

Defined results: null role or text counts as empty; a message whose parent is missing is a root; messages on a cycle
or below one belong to no path; repeated (conversation, message) ids keep every row only through ``chain``, which
numbers rows itself; ties of branch scores go to the smaller leaf; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, read, ship

# Control strings of this template and of other common chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|startoftext|>", "<|endoftext|>"]

_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|im_end\|>))*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    out = _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of it that carry loss (the assistant's texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|im_start|>{escape(role, True)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|im_end|>\n"]
        at += len(head) + len(body) + len("<|im_end|>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def chain(rows: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it in ``order``."""
    at = F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long") - 1
    return rows.withColumn("node", at).withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def tree_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """Paths of trees ``(conv_id, node, parent, score)``: one row (conv_id, leaf, rank, depth, node) per message of a path.

    depth counts from the root, rank from 1 (best mean score). ``keep`` limits the branches of a conversation.
    conv_id may be null (one conversation of its own).
    """
    nodes = messages.select(F.struct("conv_id").alias("c"), "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    sizes = nodes.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    known = nodes.select("c", F.col("node").alias("parent")).distinct()
    linked = nodes.join(known, ["c", "parent"], "left_semi").where("not node <=> parent")
    jumps = cut(linked.select("c", "node", F.col("parent").alias("up")), "jumps")
    roots = nodes.join(linked.select("c", "node"), ["c", "node"], "left_anti").select("c", F.col("node").alias("top")).distinct()
    leaves = nodes.select("c", "node").join(linked.select("c", F.col("parent").alias("node")), ["c", "node"], "left_anti").distinct()
    above = cut(leaves.select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_by")), "above")
    step = 1
    while not jumps.isEmpty():
        farther = above.join(jumps, ["c", "node"]).select("c", "leaf", F.col("up").alias("node"), (F.col("up_by") + step).alias("up_by"))
        above = cut(above.unionByName(farther), "above")
        second = jumps.select("c", F.col("node").alias("up"), F.col("up").alias("up2"))
        jumps = jumps.join(second, ["c", "up"]).select("c", "node", F.col("up2").alias("up"))
        step *= 2
        # a jump longer than the conversation goes round a cycle
        jumps = cut(jumps.join(sizes.where(F.col("size") > step), "c", "left_semi"), "jumps")
    ended = above.join(roots, (above.c == roots.c) & (above.node == roots.top), "left_semi").select("c", "leaf").distinct()
    paths = above.join(ended, ["c", "leaf"]).join(nodes.groupBy("c", "node").agg(F.max("score").alias("score")), ["c", "node"])
    totals = paths.groupBy("c", "leaf").agg(F.avg("score").alias("mean"), F.max("up_by").alias("depth"))
    best = Window.partitionBy("c").orderBy(F.desc("mean"), "leaf")
    ranked = totals.withColumn("rank", F.row_number().over(best).cast("long"))
    ranked = ranked.where(F.col("rank") <= keep) if keep else ranked
    return paths.drop("score").join(ranked, ["c", "leaf"]).select(F.col("c.conv_id").alias("conv_id"), "leaf", "rank", (F.col("depth") - F.col("up_by")).alias("depth"), "node")


def _digest(conv_id, turns: list[tuple[str, str]]) -> dict:
    formatted, spans = format_turns(turns)
    back = parse(formatted)
    loss = "".join(unescape(formatted[a:b]) for a, b in spans)
    whole = "".join(f"{role}\n{text}\n" for role, text in back)
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return {"conv_id": conv_id, "n_turns": len(back), "turns_sha256": hexed(whole), "loss_chars": len(loss), "loss_sha256": hexed(loss), "formatted_chars": len(formatted), "formatted": formatted, "loss_spans": [list(s) for s in spans]}


FORMATTED = "conv_id long, leaf long, rank long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_spans array<array<long>>"


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: the formatted string, its loss spans and digests of what ``parse`` reads back from it."""
    ship(paths.sparkSession)
    keyed = paths.withColumn("c", F.struct("conv_id")).drop("conv_id").join(messages.select(F.struct("conv_id").alias("c"), "node", "role", "text"), ["c", "node"])
    dealt = keyed.repartition("c", "leaf").sortWithinPartitions("c", "leaf", "rank", "depth")
    rows = dealt.select(F.col("c.conv_id").alias("conv_id"), "leaf", "rank", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        key, turns = None, []

        def done():
            conv, leaf, rank = key
            return _digest(conv, turns) | {"leaf": leaf, "rank": rank}

        for pdf in batches:
            out = []
            convs = [None if pd.isna(v) else int(v) for v in pdf.conv_id]
            for conv, leaf, rank, role, text in zip(convs, pdf.leaf, pdf["rank"], pdf.role, pdf.text, strict=True):
                if key != (conv, leaf, rank):
                    if key is not None:
                        out.append(done())
                    key, turns = (conv, leaf, rank), []
                turns.append((role, text))
            if out:
                yield _frame(out)
        if key is not None:
            yield _frame([done()])

    return rows.mapInPandas(write, FORMATTED)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out[[c.split()[0] for c in FORMATTED.split(", ")]]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tree = cut(chain(rows.unionByName(extra), "conv_id", ["turn", "role", "text"]).withColumn("score", F.lit(0.0)), "messages")
    out = format_paths(tree_paths(tree, keep=1), tree)
    return out.drop("formatted", "loss_spans", "leaf", "rank")
