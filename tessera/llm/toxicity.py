"""Toxicity by nearest labelled examples.

Terms are words (runs of ASCII letters, digits, underscores and all other characters beyond ASCII, lower-cased) and the
first ``BEGINNING`` bytes of longer words. A bounded sample of labelled rows (``per_class`` rows of each label, those
with the smallest hash of doc_id) gives the examples. Every term of theirs is in the index: its weight is its IDF over
all documents times its relevance, the squared z score of its shares in both classes, so that a term that says nothing
about the label hardly counts in the cosine. (Plain IDF lets rare words that two texts share by chance outweigh the
label's own: held-out recall 0.46 at sf0.1.)

The score of a text is a vote of its nearest examples by exact cosine, weighted by nearness (cosine to distance) and by how many
labelled rows an example stands for, beside one vote of the labelled share (so it is calibrated to that); it comes with its nearest examples as evidence.
All examples as near as the last of ``nearest`` vote too, so neither doc_id nor order decides a tie. An example whose
text is the scored text itself does not vote.

The index is a block-max inverted index: each term lists the blocks of examples that hold it, the largest weight in
each, and its postings there. A text opens the blocks whose bounds are the highest, and then those whose bound reaches
the nearest found so far; all others hold nothing that is as near. Its size is bounded by the sample; it is broadcast.

Defined results: null and empty texts, and texts without any term of the sample, get the labelled share as their score
and no evidence; without any labelled row of both classes the score is that share too (0 without labels); labels that
are null are left out, repeated labels of a document count once, 1 before 0; repeated rows each get their row and score
alike, also in the sample (a doc_id with several texts gives several examples); texts of any length count whole; other
columns of docs, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, flat_bytes, map_arrow, read, slices
from .shingles import Words, mix

#: Words longer than this give their first so many bytes as a term too.
BEGINNING = 5
#: Pairs of a term and a block that are looked at together.
PAIRS = 1 << 19

_U = np.uint64


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every term's occurrence in a batch of texts."""
    flat, offsets = flat_bytes(pc.utf8_lower(texts))
    letter = (flat >= 128) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57)) | (flat == 95)
    found = Words(flat, offsets, letter)
    row = np.repeat(np.arange(len(texts)), np.diff(found.first))
    long = np.flatnonzero(found.stops - found.starts > BEGINNING)
    begun = mix(found.hashes(found.starts[long], found.starts[long] + BEGINNING) ^ _U(0x5A5A5A5A5A5A5A5A))
    return np.concatenate([row, row[long]]), np.concatenate([found.hashes(found.starts, found.stops), begun])


class Vocabulary:
    """Sorted term hashes with a table of their leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = max(1, min(22, len(terms).bit_length() + 2))
        self.start = np.searchsorted(terms >> _U(64 - self.bits), np.arange((1 << self.bits) + 1).astype(np.uint64)).astype(np.int32)

    def find(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the occurrences whose term is in the vocabulary."""
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lead = (term >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        while len(row):
            more = at < end
            row, term, at, end = row[more], term[more], at[more], end[more]
            hit = self.terms[at] == term
            rows.append(row[hit])
            numbers.append(at[hit].astype(np.int64))
            row, term, at, end = row[~hit], term[~hit], at[~hit] + 1, end[~hit]
        return np.concatenate(rows), np.concatenate(numbers)

    def counted(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, times), each row's terms once, in order of row and number."""
        row, number = self.find(row, term)
        key, times = np.unique(row * len(self.terms) + number, return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), times


def sample_labels(labels: DataFrame, learn, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each class: those with the smallest hash."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.where("toxic = 0").orderBy(*order).limit(per_class))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows each term occurs, over all rows; and the number of rows. Summed up per task first."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        vocabulary, total, rows = Vocabulary(sent.value), np.zeros(len(sent.value), np.int64), 0
        for part in slices(batches, "text"):
            rows += part.num_rows
            _, number, _ = vocabulary.counted(*text_terms(part.column("text")))
            total += np.bincount(number, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["term", "n"])

    sums = map_arrow(docs.select(F.coalesce("text", F.lit("")).alias("text")), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(sums.column("term")), np.asarray(sums.column("n"))
    out = np.zeros(len(terms), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class BlockMaxIndex:
    """Exact cosine search over a bounded number of sparse vectors."""

    BLOCK = 64
    #: Terms of so large a share of the examples have their postings as a row of all examples.
    FREQUENT = 1 / 16
    #: Blocks that are opened before any is passed over.
    FIRST = 2

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], share: float, nearest: int):
        """rows: (doc_id, label, hash of the text, term numbers, times)."""
        self.vocabulary, self.share, self.nearest = Vocabulary(terms), share, nearest
        self.block = self.BLOCK
        label = np.array([r[1] for r in rows], np.int64)
        n1 = int(label.sum())
        n0 = len(rows) - n1
        self.worth = (1 - share) / n0 if n0 else 0.0, share / n1 if n1 else 0.0
        shares = [np.bincount(np.concatenate([r[3] for r in rows if r[1] == y] or [np.zeros(0, np.int64)]), minlength=len(terms)) for y in (0, 1)]
        self.weight = idf * relevance(shares[0], shares[1], n0, n1) if n0 and n1 else np.zeros(len(terms))
        vectors = [self.weight[r[3]] * (1 + np.log(r[4])) for r in rows]
        # examples with the same heaviest term lie together, so that few blocks have high bounds for it
        heaviest = [int(r[3][np.argmax(v)]) if len(v) else -1 for r, v in zip(rows, vectors, strict=True)]
        order = sorted(range(len(rows)), key=lambda i: (label[i], heaviest[i], len(vectors[i]), rows[i][2], rows[i][0]))
        self.ids = [rows[i][0] for i in order]
        self.label = label[order]
        self.text = np.array([rows[i][2] for i in order], np.int64)
        self.by_text = np.argsort(self.text, kind="stable")
        self.blocks = -(-len(rows) // self.block)
        term = np.concatenate([rows[i][3] for i in order] or [np.zeros(0, np.int64)])
        value = np.concatenate([vectors[i] / (math.sqrt(float(vectors[i] @ vectors[i])) or 1.0) for i in order] or [np.zeros(0)])
        who = np.repeat(np.arange(len(rows)), [len(rows[i][3]) for i in order])
        # frequent terms: whole rows
        often = np.bincount(term, minlength=len(terms)) > self.FREQUENT * len(rows)
        self.row_of = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.blocks * self.block))
        self.rows[self.row_of[term[often[term]]], who[often[term]]] = value[often[term]]
        term, value, who = (v[~often[term]] for v in (term, value, who))
        by = np.lexsort((who, term))
        self.who, self.value = who[by], value[by]
        pair, start = np.unique(term[by] * max(1, self.blocks) + self.who // self.block, return_index=True)
        self.pair_start, self.pair_count = start, np.diff(np.append(start, len(by)))
        self.pair_block = pair % max(1, self.blocks)
        self.pair_most = np.maximum.reduceat(self.value, start) if len(start) else np.zeros(0)
        self.term_start = np.searchsorted(pair // max(1, self.blocks), np.arange(len(terms) + 1))

    def queries(self, row: np.ndarray, number: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """The unit weights of the terms of n texts."""
        v = self.weight[number] * (1 + np.log(times))
        norm = np.sqrt(np.bincount(row, v * v, minlength=n))
        return v / np.where(norm > 0, norm, 1)[row]

    def nearest_of(self, row: np.ndarray, number: np.ndarray, times: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, near): texts x examples, near where an example votes. text: the hash of each text.

        A cosine that is not near may be left at less than it is.
        """
        n, size = len(text), len(self.ids)
        q = self.queries(row, number, times, n)
        wide = self.blocks * self.block
        frequent = self.row_of[number] >= 0
        dense = np.zeros((n, len(self.rows)))
        dense[row[frequent], self.row_of[number[frequent]]] = q[frequent]
        cosine = (dense @ self.rows).reshape(-1)
        row, number, q = row[~frequent], number[~frequent], q[~frequent]
        counts = self.term_start[number + 1] - self.term_start[number]
        pair = _spread(self.term_start[number], counts)
        owner, weight = np.repeat(row, counts), np.repeat(q, counts)
        place = owner * self.blocks + self.pair_block[pair]
        bound = cosine.reshape(n, self.blocks, self.block).max(axis=2)
        bound += np.bincount(place, weight * self.pair_most[pair], minlength=n * self.blocks).reshape(n, self.blocks)

        def open_blocks(chosen: np.ndarray) -> None:
            on = np.flatnonzero(chosen.reshape(-1)[place])
            many = self.pair_count[pair[on]]
            at = _spread(self.pair_start[pair[on]], many)
            np.add(cosine, np.bincount(np.repeat(owner[on] * wide, many) + self.who[at], np.repeat(weight[on], many) * self.value[at], minlength=n * wide), out=cosine)

        lo = np.searchsorted(self.text[self.by_text], text)
        hi = np.searchsorted(self.text[self.by_text], text, side="right")
        own = np.repeat(np.arange(n), hi - lo), self.by_text[_spread(lo, hi - lo)]
        last = min(self.nearest, size)

        def least() -> tuple[np.ndarray, np.ndarray]:
            now = np.round(cosine.reshape(n, wide)[:, :size], 9)
            now[own] = 0
            return now, np.partition(now, size - last, axis=1)[:, size - last]

        first = np.zeros((n, self.blocks), bool)
        most = min(self.FIRST, self.blocks)
        np.put_along_axis(first, np.argpartition(-bound, most - 1, axis=1)[:, :most], True, axis=1)
        open_blocks(first)
        _, floor = least()
        open_blocks(~first & (bound >= floor[:, None] - 1e-8) & (bound > 0))
        now, floor = least()
        return now, (now >= floor[:, None]) & (now > 0)

    def score(self, row: np.ndarray, number: np.ndarray, times: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        n = len(text)
        if not self.worth[0] or not self.worth[1]:
            return np.full(n, self.share), [[] for _ in range(n)]
        cosine, near = self.nearest_of(row, number, times, text)
        one = sum(self.worth) / 2
        vote = np.where(near, cosine / (1 - np.minimum(cosine, 1) + 0.02), 0)
        toxic, clean = vote @ (self.label * self.worth[1]), vote @ ((1 - self.label) * self.worth[0])
        scores = (self.share * one + toxic) / (one + toxic + clean)
        evidence = []
        for k in range(n):
            voters = np.flatnonzero(near[k])
            best = sorted(voters.tolist(), key=lambda i: (-cosine[k, i], self.ids[i]))[:5]
            evidence.append([self.ids[i] for i in best])
        return np.clip(np.round(scores, 9), 0, 1), evidence


def relevance(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """The squared z score of a term's shares in n0 and n1 texts (one text more is counted for its variance)."""
    spread = (clean + toxic + 1) / (n0 + n1) * (1 / n0 + 1 / n1)
    return (toxic / n1 - clean / n0) ** 2 / spread


def build_index(docs: DataFrame, labels: DataFrame, learn, per_class: int, nearest: int) -> BlockMaxIndex:
    sample = cut(sample_labels(labels, learn, per_class), "labels").coalesce(1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"))
    chosen = rows.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"), "hash", "text").where("text <> ''").distinct()

    def take(batches):
        for part in slices(batches, "text"):
            row, term = text_terms(part.column("text"))
            sets = [np.unique(term[row == k], return_counts=True) for k in range(part.num_rows)]
            lists = [pa.array([s[i].view(np.int64) for s in sets], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("hash"), *lists], ["doc_id", "toxic", "hash", "terms", "times"])

    taken = cut(map_arrow(chosen, take, "doc_id long, toxic long, hash long, terms array<long>, times array<long>"), "examples").toArrow()
    ids, toxic, text = (taken.column(c).to_pylist() for c in ("doc_id", "toxic", "hash"))
    terms = [np.asarray(v.values, np.int64).view(np.uint64) for v in taken.column("terms")]
    times = [np.asarray(v.values, np.int64) for v in taken.column("times")]
    vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
    frequency, total = document_frequencies(docs, vocabulary)
    idf = np.log((2 + total) / (1 + frequency))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    share = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    examples = [(i, t, h, np.searchsorted(vocabulary, s), n) for i, t, h, s, n in zip(ids, toxic, text, terms, times, strict=True) if len(s)]
    return BlockMaxIndex(vocabulary, idf, examples, share, nearest)


def toxicity(docs: DataFrame, labels: DataFrame, learn, per_class: int = 600, nearest: int = 15, key: str | None = None) -> DataFrame:
    """``(doc_id, score, evidence)`` of every row of docs. ``learn``: which labelled rows may be learnt from.

    key: a string column of docs that comes out beside doc_id.
    """
    passed = [key] if key else []
    sent = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels, learn, per_class, nearest))

    def run(batches):
        index = sent.value
        for part in slices(batches, "text"):
            row, number, times = index.vocabulary.counted(*text_terms(part.column("text")))
            text = np.asarray(part.column("hash"))
            scores, evidence = np.full(part.num_rows, index.share), [[] for _ in range(part.num_rows)]
            # as many texts at a time as have PAIRS pairs of a term and a block
            pairs = np.bincount(row, index.term_start[number + 1] - index.term_start[number], minlength=part.num_rows)
            group = (np.cumsum(pairs) - pairs) // PAIRS
            ends = np.flatnonzero(np.append(np.diff(group), 1)) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                lo, hi = np.searchsorted(row, [a, b])
                if hi > lo:
                    scores[a:b], evidence[a:b] = index.score(row[lo:hi] - a, number[lo:hi], times[lo:hi], text[a:b])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *passed)), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", *passed, "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in passed], F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id long, {''.join(f'{c} string, ' for c in passed)}score double, evidence array<long>")


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
