"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two primes, the hash of each of its prefixes; from it any span's hash, hence any
equality of spans, is a few multiplications, and the longest common extension of two places is a binary search.
A fingerprint is the text's length, its whole hash and the smallest ``SKETCH`` distinct hashes of its spans of
``SPAN`` code points (its whole hash where it is shorter). The likeness of two fingerprints estimates the Jaccard
similarity of their span sets.

``neighbours`` walks a table in key order without gathering it: one range exchange of the texts, then a stream through
each range; only each range's first and last text meet again.

Defined results: null text counts as empty; empty texts have no spans, are alike to empty texts only; rows with equal
keys are ordered by the text's hash; null keys come last; a table of one row is its own neighbour.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, map_arrow, read

# Two primes under 2 ** 31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003 * 1009 % 2147483647, 998244353)

SPAN = 16
SKETCH = 40

_U = np.uint64


class Powers:
    """Powers of a base and of its inverse modulo a prime, as far as any text has needed them."""

    def __init__(self, base: int, prime: int):
        self.prime, self.steps = prime, (base, pow(base, -1, prime))
        self.up = self.down = np.ones(1, np.int64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up, self.down = (np.concatenate([a, a * pow(s, m, self.prime) % self.prime]) for a, s in zip((self.up, self.down), self.steps, strict=True))


_POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class Prefixes:
    """Prefix hashes of one sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.rows = []
        for power in _POWERS:
            power.reach(self.n + 1)
            row = np.zeros(self.n + 1, np.int64)
            np.cumsum((codes + 1) * power.up[: self.n] % power.prime, out=row[1:])
            self.rows.append(row % power.prime)

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """The hash of the span; equal spans, wherever they are, have equal hashes."""
        return tuple(int(row[stop] - row[start]) * int(p.down[start]) % p.prime for row, p in zip(self.rows, _POWERS, strict=True))

    def spans(self, width: int) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of ``width`` code points; of the whole where it is shorter; none if empty."""
        if not self.n:
            return np.zeros(0, np.uint64)
        width = min(width, self.n)
        a, b = ((row[width:] - row[: self.n - width + 1]) % p.prime * p.down[: self.n - width + 1] % p.prime for row, p in zip(self.rows, _POWERS, strict=True))
        return mix((a.astype(np.uint64) << _U(31)) | b.astype(np.uint64))


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points agree from place i of a and place j of b on: a binary search over span equalities."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest SKETCH distinct values, 32 bits each."""
    few = 4 * SKETCH
    if len(hashes) > few:
        least = np.unique(np.partition(hashes, few)[:few] >> _U(32))
        if len(least) >= SKETCH:
            return least[:SKETCH].astype(np.uint32)
    return np.unique(hashes >> _U(32))[:SKETCH].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


class Text:
    """A text with its code points, prefix hashes, span hashes and sketch."""

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.prefixes = Prefixes(self.codes)
        self.hashes = self.prefixes.spans(SPAN)
        self.sketch = sketch(self.hashes)
        self.n = self.prefixes.n

    def whole(self) -> bytes:
        return fingerprint(self.n, self.prefixes.span(0, self.n), self.sketch)


def fingerprint(n: int, whole: tuple[int, ...], least: np.ndarray) -> bytes:
    return struct.pack(">QII", n, *whole) + least.astype(">u4").tobytes()


def spliced(a: Text, keep: int, b: Text, take: int) -> tuple[bytes, np.ndarray]:
    """Fingerprint and sketch of a's first ``keep`` code points followed by b's first ``take``, from their arrays."""
    n = keep + take
    whole = tuple((x + int(p.up[keep]) * y) % p.prime for x, y, p in zip(a.prefixes.span(0, keep), b.prefixes.span(0, take), (_reached(p, n) for p in _POWERS), strict=True))
    if n < SPAN:
        hashes = Prefixes(np.concatenate([a.codes[:keep], b.codes[:take]])).spans(SPAN)
    else:
        seam = np.concatenate([a.codes[max(0, keep - SPAN + 1) : keep], b.codes[: min(take, SPAN - 1)]])
        across = Prefixes(seam).spans(SPAN) if len(seam) >= SPAN else np.zeros(0, np.uint64)
        hashes = np.concatenate([a.hashes[: max(0, keep - SPAN + 1)] if a.n >= SPAN else a.hashes[:0], across, b.hashes[: max(0, take - SPAN + 1)] if b.n >= SPAN else b.hashes[:0]])
    least = sketch(hashes)
    return fingerprint(n, whole, least), least


def _reached(power: Powers, n: int) -> Powers:
    power.reach(n + 1)
    return power


def compared(a: Text, b: Text) -> dict:
    """The columns that compare a text with its edited form and with the next text."""
    half = a.n // 2
    keep, take = a.n - half, min(half, b.n)
    mark, least = spliced(a, keep, b, take)
    edited = a.text[:keep] + b.text[:take]
    tail = common_extension(a.prefixes, keep, b.prefixes, 0)
    return {
        "n_chars": a.n,
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "mark": a.whole(),
        "edited_mark": mark,
        "near_edited": likeness(a.sketch, least),
        "near_next": likeness(a.sketch, b.sketch),
        "prefix_edited": keep + min(tail, take),
        "prefix_next": common_extension(a.prefixes, 0, b.prefixes, 0),
    }


_RESULT = "key long, n_chars long, edited_sha256 string, mark binary, edited_mark binary, near_edited double, near_next double, prefix_edited long, prefix_next long"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


#: Bytes of text in a range, at most on the average.
RANGE_BYTES = 128 << 20

_ARROW = [("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("mark", pa.binary()), ("edited_mark", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("prefix_edited", pa.int64()), ("prefix_next", pa.int64())]
_EDGES = [("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())]


def neighbours(df: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """``compared`` of each row with the next one in descending order of ``key`` (the first one after the last)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").desc_nulls_last(), F.xxhash64("text")]
    # by the text too: rows without a key, or with the same one, may be many
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema(_ARROW + _EDGES)

    def walk(batches):
        part = TaskContext.get().partitionId()

        def found():
            first, key, held = None, None, None
            for batch in batches:
                for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                    now = Text(t.as_py())
                    if held is None:
                        first = now.text
                    else:
                        yield {"key": key} | compared(held, now)
                    key, held = k, now
            if held is not None:
                yield {"key": key, "part": part, "first_text": first, "last_text": held.text}

        return _batches(found(), schema)

    walked = cut(map_arrow(ranged, walk, _RESULT + ", part int, first_text string, last_text string"), "neighbours")
    done = walked.where("part is null").select(*_NAMES)
    # one row per range that has rows: its last row still waits for the first of the next range
    edges = walked.where("part is not null")
    ring = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy(F.lit(1)))).alias("then"))
    waits = edges.select("part", "key", F.col("last_text").alias("text")).join(ring, "part")
    waits = waits.join(edges.select(F.col("part").alias("then"), F.col("first_text").alias("next_text")), "then")

    def close(batches):
        def found():
            for batch in batches:
                for row in batch.to_pylist():
                    yield {"key": row["key"]} | compared(Text(row["text"]), Text(row["next_text"]))

        return _batches(found(), pa.schema(_ARROW))

    return done.unionByName(map_arrow(waits.select("key", "text", "next_text"), close, _RESULT))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    out = neighbours(docs, "doc_id", "text", parts)
    return out.select(
        F.col("key").alias("doc_id"), "n_chars", "edited_sha256",
        F.lower(F.hex("mark")).alias("fingerprint"), F.lower(F.hex("edited_mark")).alias("edited_fingerprint"),
        "near_edited", "near_next", "prefix_edited", "prefix_next",
    )
