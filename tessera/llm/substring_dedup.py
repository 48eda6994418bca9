"""Exact removal of repeated byte strings across a corpus by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or same document and
earlier start). Every such string has an anchor: of its ``GRAM``-byte strings the first one with the smallest hash. Equal
strings have equal anchors at equal places, so only texts around equal anchors need to be compared:

1. Each scan task finds the anchors of its whole texts with a hash of all the strings that have the anchor (its
   context), marks repeats of a context within the task and sends on the first of each.
2. Sorted by anchor and context, all but the first of a context are marked. Anchors with several contexts go on.
3. Their contexts' bytes are fetched and cut down to what occurs in two contexts. What lies within another context at
   the same place of the anchor takes that one's strings; the others are sorted by a suffix array (linear grouping),
   where neighbours that share LENGTH bytes are one string. Of each string the earliest start stays. Anchors with more
   than ``BLOCK`` contexts are split over tasks; the strings of such blocks then meet in one sum per string.
4. The marks of each document are united and its bytes cut.

A document is a doc_id with a text. Defined results: null text counts as empty; texts shorter than LENGTH lose nothing;
texts of any length count whole; rows that repeat both doc_id and text are one document (each row gets its result);
rows with equal doc_id and different texts are different documents, in order of their texts' hashes; null doc_ids come
after all others, likewise; only doc_id, text and the carried columns are read; an empty table gives an empty result.
The order of rows decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, discard, map_arrow, read, release, slices
from .shingles import mix, powers
from .suffix_arrays import suffix_array

LENGTH = 100
GRAM = 40
#: Contexts of an anchor in one task, bytes of one suffix array, anchors held by a scan task.
BLOCK, ARRAY_BYTES, HELD = 1024, 1 << 16, 2_000_000
#: Contexts of an anchor that a scan task sends to the anchor's own task; contexts that a task sorts on the average.
MET, SORTED = 8, 16_384
#: Anchors that are sent to every task, where the contexts are more than a task takes (16 bytes each).
SENT = 500_000

_U = np.uint64

def _slide(v: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = pick(v[:-size], v[size:])
        size *= 2
    return pick(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    down = powers(len(prefix))[1]
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, context hashes, places, and the bytes of context on the left and right of each place."""
    n = len(data)
    prefix = _prefix(data)
    begin = np.arange(n - GRAM + 1)
    grams = _span_hash(prefix, begin, begin + GRAM)
    window = LENGTH - GRAM + 1
    least = _slide(grams, window, np.minimum)
    # runs of windows with the same least hash, and the places inside them that have it
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    stops = np.append(starts[1:], len(least))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    at = np.flatnonzero(grams == _slide(padded, window, np.maximum)[: len(grams)])
    first, end = np.searchsorted(at, starts), np.searchsorted(at, stops + window - 1)
    count = end - first
    run = np.repeat(np.arange(len(starts)), count)
    place = at[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    mine = grams[place] == least[starts[run]]
    run, at = run[mine], place[mine]
    # a window belongs to the first of its places: a text that repeats itself has many
    before = np.full(len(at), -1)
    before[1:] = np.where(run[1:] == run[:-1], at[:-1], -1)
    lo, hi = np.maximum(np.maximum(at - window + 1, starts[run]), before + 1), np.minimum(at, stops[run] - 1)
    some = lo <= hi
    at, lo, hi = at[some], lo[some], hi[some]
    left, right = at - lo, hi + LENGTH - at
    context = mix(_span_hash(prefix, at - left, at + right) ^ (left * 256 + right).astype(np.uint64))
    return grams[at], context, at, left, right


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``doc`` and ``alt``, in whose order documents come: doc_id (null: the greatest), then the text's hash.

    The hash is left out (0) where a doc_id has one text only.
    """
    rows = docs.withColumn("_h", F.xxhash64("text"))
    several = rows.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo <> hi")
    several = cut(several.select("doc", F.lit(True).alias("_s")), "several")
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    alone = F.col("doc_id").isNotNull()
    if several.count():
        rows = rows.join(several, "doc", "left")
        alone = alone & F.col("_s").isNull()
    return rows.withColumn("alt", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("_h"))).drop("_h", "_s")


def _pack(at, left, right):
    return (at << 16) | (left << 8) | right


NAMES = ["anchor", "salt", "context", "doc", "alt", "where", "marked"]


def first_contexts(docs: DataFrame) -> DataFrame:
    """``(anchor, salt, context, doc, alt, where, marked)``: the first of each context in a scan task, or a mark (repeat within it).

    Where a task has more than MET contexts of an anchor, the others go on anyway: they get a salt by their context, so
    that no task receives all contexts of a frequent anchor.
    """

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, context, number, doc, alt, where = (np.concatenate(c) for c in zip(*found, strict=True))
        # documents by one number, in their order
        order = np.lexsort((alt, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (alt[order][1:] != alt[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        rank = rank[number]
        order = np.lexsort((where, rank, context, anchor))
        anchor, context, rank, where, number = anchor[order], context[order], rank[order], where[order], number[order]
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        again = ~new_anchor
        again[1:] &= context[1:] == context[:-1]
        same = np.zeros(len(order), bool)
        same[1:] = again[1:] & (rank[1:] == rank[:-1]) & (where[1:] == where[:-1])
        # the how-manieth context of its anchor
        distinct = np.cumsum(~again)
        nth = distinct - np.maximum.accumulate(np.where(new_anchor, distinct, 0))
        far = (context >> _U(32)).astype(np.int64) & 1023
        anywhere = ((where >> 16) * 31 + number * 17) & 1023
        salt = np.where(again, 1 + anywhere, np.where(nth >= MET, 2000 + far, 0)).astype(np.int32)
        keep = ~same
        for a in range(0, len(order), 100_000):
            part = np.flatnonzero(keep[a : a + 100_000]) + a
            who = number[part]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[part].view(np.int64)), pa.array(salt[part]), pa.array(context[part].view(np.int64)), pa.array(doc[who]), pa.array(alt[who]), pa.array(where[part]), pa.array(again[part])], NAMES)

    def run(batches):
        found, held = [], 0
        for part in slices(batches, "text"):
            for doc, alt, text in zip(part.column("doc").to_pylist(), part.column("alt").to_pylist(), part.column("text"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else np.zeros(0, np.uint8)
                if len(data) < LENGTH:
                    continue
                anchor, context, at, left, right = anchors(data)
                found.append((anchor, context, np.full(len(at), len(found)), [doc], [alt], _pack(at, left, right)))
                held += len(at)
            if held >= HELD:
                yield from flush(found)
                found, held = [], 0
        if found:
            yield from flush(found)

    return map_arrow(docs.select("doc", "alt", "text"), run, CONTEXTS)


CONTEXTS = "anchor long, salt int, context long, doc long, alt long, where long, marked boolean"


def sift(contexts: DataFrame) -> DataFrame:
    """All repeats of a context, marked; and the first ones of anchors with several contexts, which go on (marked false)."""
    # what is marked already only passes through, anywhere
    dealt = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "context", "doc", "alt", "where")
    keys = [n for n in NAMES if n != "marked"]

    def run(batches):
        held = None  # the first row of the anchor in hand, while it has one context
        last = None
        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in keys]
            known = np.asarray(batch.column("marked").to_numpy(zero_copy_only=False), bool)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[known]) for v in (*columns, known)], NAMES)
            columns = [v[~known] for v in columns]
            if not len(columns[0]):
                continue
            before = [np.concatenate([[v[0] if last is None else last[k]], v[:-1]]) for k, v in enumerate(columns)]
            anchor, salt, context, doc, alt, where = (v != b for v, b in zip(columns, before, strict=True))
            new_anchor = anchor | salt
            new_context = new_anchor | context
            if last is None:
                new_anchor[0] = new_context[0] = True
            marked = ~new_context & (doc | alt | where)
            # an owner goes on if its anchor has another context: before it, after it, or in another task
            another = new_context & ~new_anchor
            sure = new_context & (columns[1] > 0)
            out = another | sure | marked
            owners = np.flatnonzero(new_context)
            out[owners[:-1][another[owners[1:]]]] = True
            if held is not None and len(owners) and another[owners[0]]:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, False), (c.type for c in batch.columns), strict=True)], NAMES)
            if len(owners):
                o = owners[-1]
                held = tuple(int(v[o]) for v in columns) if new_anchor[o] and not sure[o] else None
            last = [v[-1] for v in columns]
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (*columns, marked)], NAMES)

    return map_arrow(dealt.select(*NAMES), run, CONTEXTS).drop("salt", "context")


def fetch(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """``(anchor, doc, alt, at, left, bytes)`` of owners (anchor, doc, alt, where)."""
    per_doc = owners.groupBy("doc", "alt").agg(F.collect_list(F.struct("anchor", "where")).alias("places"))
    rows = docs.select("doc", "alt", "text").join(per_doc, ["doc", "alt"]).select("doc", "alt", "text", "places.anchor", "places.where")

    def run(batches):
        for part in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for doc, alt, text, anchor, where in zip(part.column("doc").to_pylist(), part.column("alt").to_pylist(), part.column("text"), part.column("anchor").to_pylist(), part.column("where").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for a, w in zip(anchor, where, strict=True):
                    at, left, right = w >> 16, (w >> 8) & 255, w & 255
                    for o, v in zip(out, (a, doc, alt, at, left, data[at - left : at + right]), strict=True):
                        o.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["anchor", "doc", "alt", "at", "left", "bytes"])

    return map_arrow(rows, run, "anchor long, doc long, alt long, at long, left int, bytes binary")


def array_classes(strings: list[bytes]) -> list[np.ndarray]:
    """Classes of equal LENGTH-byte strings: for each string, the class number of every start (by suffix array)."""
    symbols: list[int] = []
    base = []
    for s in strings:
        base.append(len(symbols))
        symbols.extend(s)
        symbols.append(256)
    flat = np.array(symbols, np.uint16)
    order = np.array(suffix_array(symbols))
    whole = np.zeros(len(flat), bool)
    for b, s in zip(base, strings, strict=True):
        whole[b : b + len(s) - LENGTH + 1] = True
    order = order[whole[order]]
    views = sliding_window_view(flat, LENGTH)
    differs = np.ones(len(order), bool)
    for a in range(1, len(order), 4096):
        part = slice(a, min(a + 4096, len(order)))
        differs[part] = (views[order[part]] != views[order[a - 1 : part.stop - 1]]).any(axis=1)
    named = np.zeros(len(flat), np.int64)
    named[order] = np.cumsum(differs)
    return [named[b : b + len(s) - LENGTH + 1] for b, s in zip(base, strings, strict=True)]


class _Sorter:
    """Takes blocks of contexts of an anchor; gives marks (doc, lo, hi) and, for split anchors, their strings.

    doc: the pair (doc, alt).
    """

    def __init__(self):
        self.marks: list[tuple[tuple[int, int], int, int]] = []
        self.strings: list[tuple[bytes, tuple[int, int], int]] = []
        # texts to be sorted; what lies in them: text, place in it, doc, place of its start in doc, strings, of a split anchor
        self.texts: list[bytes] = []
        self.waiting: list[tuple[int, int, tuple[int, int], int, int, bool]] = []
        self.bytes = 0

    def block(self, rows: list[tuple[tuple[int, int], int, int, bytes]], split: bool) -> None:
        """rows: (doc, at, left, bytes) of one anchor; a place that came twice (a repeated row) counts once."""
        rows = list({(r[0], r[1]): r for r in rows}.values())
        flat = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        prefix = _prefix(flat)
        count = sizes - LENGTH + 1
        begin = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = np.repeat(np.arange(len(rows)), count)
        if not split:
            _, where, times = np.unique(_span_hash(prefix, begin, begin + LENGTH), return_inverse=True, return_counts=True)
            again = times[where] > 1
            begin, owner = begin[again], owner[again]
            if not len(begin):
                return
        who, first = np.unique(owner, return_index=True)
        last = np.append(first[1:], len(owner)) - 1
        distinct: dict[tuple[int, bytes], tuple[tuple[int, int], int]] = {}
        for o, a, b in sorted(zip(who.tolist(), begin[first].tolist(), begin[last].tolist(), strict=True), key=lambda x: rows[x[0]][:2]):
            doc, at, left, data = rows[o]
            a, b = a - int(starts[o]), b - int(starts[o]) + LENGTH
            key = (a - left, data[a:b])
            place = at - left + a
            if key in distinct:
                self.marks.append((doc, place, place + b - a))
            else:
                distinct[key] = (doc, place)
        if len(distinct) == 1 and not split:
            return
        # equal strings lie at equal places of the anchor, so what lies within a longer text there has its strings
        kept: list[tuple[int, bytes, int]] = []
        for (shift, s), (doc, place) in sorted(distinct.items(), key=lambda x: -len(x[0][1])):
            for other, text, number in kept:
                skip = shift - other
                if skip >= 0 and text.startswith(s, skip):
                    break
            else:
                skip, number = 0, len(self.texts)
                kept.append((shift, s, number))
                self.texts.append(s)
                self.bytes += len(s) + 1
            self.waiting.append((number, skip, doc, place, len(s) - LENGTH + 1, split))
        if len(kept) == 1:
            # all strings of one text at different places are met apart: no order is needed to tell them from each other
            own = self.waiting[-len(distinct) :]
            del self.waiting[-len(distinct) :]
            self.bytes -= len(self.texts.pop()) + 1
            self.resolve([(range(skip, skip + n), doc, place, kept[0][1], skip, split_) for _, skip, doc, place, n, split_ in own])
        elif self.bytes >= ARRAY_BYTES:
            self.sort()

    def sort(self) -> None:
        texts, waiting = self.texts, self.waiting
        self.texts, self.waiting, self.bytes = [], [], 0
        if texts:
            named = [c.tolist() for c in array_classes(texts)]
            self.resolve([(named[number][skip : skip + n], doc, place, texts[number], skip, split) for number, skip, doc, place, n, split in waiting])

    def resolve(self, waiting: list[tuple[Sequence[int], tuple[int, int], int, bytes, int, bool]]) -> None:
        """waiting: (classes of the strings, doc, place of the first, their text, its place there, of a split anchor)."""
        first: dict[int, tuple[tuple[int, int], int]] = {}
        # in order of documents and places; a class that is had already keeps its first start
        for classes, doc, place, *_ in sorted(waiting, key=lambda w: (w[1], w[2])):
            for k, c in enumerate(classes):
                if c not in first or (doc, place + k) < first[c]:
                    first[c] = (doc, place + k)
        for classes, doc, place, text, skip, split in waiting:
            run = None
            for k, c in enumerate(classes):
                if first[c] == (doc, place + k):
                    if split:
                        self.strings.append((hashlib.blake2b(text[skip + k : skip + k + LENGTH], digest_size=16).digest(), doc, place + k))
                    if run is not None:
                        self.marks.append((doc, place + run, place + k - 1 + LENGTH))
                        run = None
                elif run is None:
                    run = k
            if run is not None:
                self.marks.append((doc, place + run, place + len(classes) - 1 + LENGTH))


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """``(doc, alt, lo, hi, string)``: marks (string null), and the first start in its block of each string of a split anchor."""
    many = cut(contexts.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("blocks > 1"), "blocks")
    tasks = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() // SORTED))
    dealt = contexts.join(F.broadcast(many) if many.count() <= SENT else many, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc", "alt", "at"), F.col("blocks")))
    # as many tasks as the rows need: the work is not in the bytes that are exchanged
    dealt = dealt.repartition(tasks, "anchor", "block").sortWithinPartitions("anchor", "block")

    def emit(sorter: _Sorter):
        marks, strings = sorter.marks, sorter.strings
        sorter.marks, sorter.strings = [], []
        docs = [m[0] for m in marks] + [s[1] for s in strings]
        los = [m[1] for m in marks] + [s[2] for s in strings]
        his = [m[2] for m in marks] + [s[2] + LENGTH for s in strings]
        names = [None] * len(marks) + [s[0] for s in strings]
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()), pa.array(los, pa.int64()), pa.array(his, pa.int64()), pa.array(names, pa.binary())], ["doc", "alt", "lo", "hi", "string"])

    def run(batches):
        sorter, key, rows, split = _Sorter(), None, [], False
        for batch in batches:
            for anchor, block, blocks, doc, alt, at, left, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "blocks", "doc", "alt", "at", "left", "bytes")), strict=True):
                if key != (anchor, block):
                    if rows:
                        sorter.block(rows, split)
                    key, rows, split = (anchor, block), [], blocks > 1
                rows.append(((doc, alt), at, left, data))
            if sorter.marks or sorter.strings:
                yield emit(sorter)
        if rows:
            sorter.block(rows, split)
        sorter.sort()
        yield emit(sorter)

    return map_arrow(dealt.select("anchor", "block", "blocks", "doc", "alt", "at", "left", "bytes"), run, "doc long, alt long, lo long, hi long, string binary")


def repeats(docs: DataFrame) -> DataFrame:
    """Marks ``(doc, alt, lo, hi)`` of rows ``(doc, alt, text)``: every byte between is to go."""
    spark = docs.sparkSession
    sifted = cut(sift(first_contexts(docs)), "sifted")
    release(spark)
    contexts = cut(fetch(docs, sifted.where("not marked").select("anchor", "doc", "alt", "where")), "bytes")
    release(spark)
    sorted_ = cut(sort_contexts(contexts), "sorted")
    discard(contexts)
    release(spark)
    strings = sorted_.where("string is not null")
    first = strings.groupBy("string").agg(F.min(F.struct("doc", "alt", "lo")).alias("first"))
    later = strings.join(first, "string").where("first.doc <> doc or first.alt <> alt or first.lo <> lo").select("doc", "alt", "lo", "hi")
    at = F.shiftright("where", 16)
    wide = sifted.where("marked").select("doc", "alt", (at - F.shiftright("where", 8).bitwiseAND(F.lit(255))).alias("lo"), (at + F.col("where").bitwiseAND(F.lit(255))).alias("hi"))
    return wide.unionByName(sorted_.where("string is null").select("doc", "alt", "lo", "hi")).unionByName(later)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, kept_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` of every row of docs(doc_id, text).

    kept: the remaining bytes as text; a character that was cut in two is dropped. carry: columns to pass through.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    rows = keyed(rows)
    marks = repeats(rows.select("doc", "alt", "text"))
    # one row per document: its marks, as many as it has anchors at most
    per_doc = marks.groupBy("doc", "alt").agg(F.collect_list(F.struct("lo", "hi")).alias("m")).select("doc", "alt", "m.lo", "m.hi")
    joined = rows.join(per_doc, ["doc", "alt"], "left").select("doc_id", "text", *(F.col("carry")[c].alias(f"carry_{c}") for c in carry), "lo", "hi")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept_text
    passed = [f"carry_{c}" for c in carry]

    def run(batches):
        for part in slices(batches, "text"):
            out: list[list] = [[] for _ in names[1:]]
            for text, lo, hi in zip(part.column("text"), part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, removed, spans, at = [], 0, 0, 0
                if lo:
                    stop = -1
                    for a, b in sorted(zip(lo, hi, strict=True)):
                        if a > stop:
                            spans += 1
                            kept.append(data[at:a])
                            removed += b - a
                            stop = b
                        elif b > stop:
                            removed += b - stop
                            stop = b
                        at = stop
                kept = b"".join([*kept, data[at:]])
                values = [len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")]
                for o, v in zip(out, values, strict=False):
                    o.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(o, t) for o, t in zip(out, types, strict=False)), *(part.column(c) for c in passed)], names + passed)

    extra = "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in passed)
    done = map_arrow(joined, run, _RESULT + (", kept string" if kept_text else "") + extra)
    return done.select(*names, *(F.col(f"carry_{c}").alias(c) for c in carry))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
