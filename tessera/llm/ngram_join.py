"""N-gram Jaccard join by a token-group matrix.

Rows with the same shingle set are one record. Records are partitioned into groups of similar records (same smallest
shingle hash, dealt by a hash into blocks of ``GROUP`` members on the average). The matrix has a row for each group:
the tokens of its members' prefixes, and the union of all its members' tokens as a bitmap of ``BITS`` hashed places. A
record queries only groups that hold ``SHARED`` of its rarest tokens (of n, the first n - ceil(t n) + SHARED in order
of a corpus-wide frequency sketch: two records of similarity t share that many of those, or all that they must share
if that is fewer) and whose sizes fit. The union bounds the overlap: every place of the query's bitmap that the
group's lacks is a token at least that no member has. Only where the bound allows t n common tokens is the group
opened: its members' and the query's whole sets are fetched and the exact similarities counted. The result is exact
whatever the grouping. (A record of n < t / (1 - t) tokens is like no other set, and queries nothing.)

First each group is joined with itself and with a few pivots of its kind, then each record with the pivots of its rare
tokens; records that this connects need no further comparison with each other, so large groups of near copies are not
compared pair by pair. Links come out as a spanning
forest of each opened group (no link between different components is lost).

Defined results of ``jaccard_components``: null and empty texts, and texts without words, have n = 0 and are linked
with nothing; rows with the same doc_id count as one document, whatever their texts (its texts' links are its own);
a null doc_id is linked with nothing and its component is null; whole texts of any length count; only doc_id and text
of the table are read; an empty table gives an empty result. The order of rows decides nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard, map_arrow, read, release, slices, steps
from .shingles import mix, shingle_sets

#: Members of a group, queries that meet it in one task, pivots of a kind, buckets of the frequency sketch.
GROUP, QUERIES, PIVOTS, BUCKETS = 64, 512, 8, 1 << 16
#: Rare tokens that a record and a group must share.
SHARED = 3
#: Rounds of comparison with pivots of tokens before records are compared with groups.
PASSES = 2
#: Places of a bitmap of tokens (a power of two, and of longs).
BITS = 1024
WORDS = [f"b{i}" for i in range(BITS // 64)]
#: Records whose keys are sent to every task that reads texts (some 70 bytes each, and 40 for each group that a record goes to,
#: two on the average at most); more of them meet the texts in an exchange.
SENT = 500_000

_U = np.uint64


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, text)``: an id and the hash of its text tell the texts of a corpus apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def token_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, token) pairs of the whole corpus fall into each hash bucket: a sketch of fixed size."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text"):
            for s in shingle_sets(part.column("text"), k):
                np.add.at(total, (s >> _U(48)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = map_arrow(docs.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    return out


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(uid, doc_id, h, n, k1, k2, kind, prefix, b0..)`` of every row.

    uid: a number of the row; n, k1, k2: size and hashes of its set; kind: smallest token; prefix: the rarest tokens,
    which a link must share; b0..: the bitmap of the set.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(token_frequencies(docs, k))
    names = ["doc_id", "h", "n", "k1", "k2", "kind", "prefix", *WORDS]

    def run(batches):
        common = sketch.value
        for part in slices(batches, "text"):
            n, k1, k2, kind, prefix = [], [], [], [], []
            bits = np.zeros((part.num_rows, BITS), bool)
            for row, s in enumerate(shingle_sets(part.column("text"), k)):
                m = len(s)
                n.append(m)
                if not m:
                    k1.append(0), k2.append(0), kind.append(0), prefix.append(s)
                    continue
                bits[row, (s >> _U(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
                k1.append(int(mix(s).sum(dtype=np.uint64)))
                k2.append(int(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                kind.append(int(s[0]))
                least = m - -(-m * num // den) + SHARED if m * (den - num) >= num else 0
                order = np.lexsort((s, common[(s >> _U(48)).astype(np.int64)]))
                prefix.append(s[order[:least]])
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), signed(k1), signed(k2), signed(kind), lists, *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names)

    made = map_arrow(_rows(docs), run, "doc_id long, h long, n long, k1 long, k2 long, kind long, prefix array<long>" + "".join(f", {w} long" for w in WORDS))
    # numbered once, by being written
    return cut(made.withColumn("uid", F.monotonically_increasing_id()), "signatures")


def same_text(a: Column, b: Column, h: Column, g: Column) -> Column:
    return a.eqNullSafe(b) & (h == g)


def full_sets(docs: DataFrame, grouped: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` (grp, salt, is_query, rec) with the ``tokens`` of each record: all hashes of its set, as bytes.

    Where a record goes travels with its key to the text, so that sets are exchanged once, by group, and never written.
    A row that repeats gives its set once a task at least.
    """

    def run(batches):
        given: set[int] = set()
        for part in slices(batches, "text"):
            recs = part.column("rec").to_pylist()
            fresh = [i for i, r in enumerate(recs) if r not in given and not given.add(r)]
            part = part.take(pa.array(fresh, pa.int64())) if len(fresh) < len(recs) else part
            yield pa.RecordBatch.from_arrays([part.column("rec"), part.column("to"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), k)], pa.binary())], ["rec", "to", "tokens"])

    places = asked.groupBy("rec").agg(F.collect_list(F.struct("grp", "salt", "is_query")).alias("to"))
    wanted = cut(places.join(grouped.select("rec", "doc_id", "h"), "rec"), "wanted").select("rec", "to", F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    much = wanted.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("to")).alias("places")).first()
    wanted = F.broadcast(wanted) if much["records"] <= SENT and (much["places"] or 0) <= 2 * SENT else wanted
    rows = _rows(docs).where("text <> ''")
    met = rows.join(wanted, same_text(rows["doc_id"], wanted["_d"], rows["h"], wanted["_h"])).select("rec", "to", "text")
    made = map_arrow(met, run, "rec long, to array<struct<grp: long, salt: long, is_query: boolean>>, tokens binary")
    return made.select(F.explode("to").alias("to"), "rec", "tokens").select("to.grp", "to.salt", "to.is_query", "rec", "tokens")


class Forest:
    """Union-find over the records of one opened group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Group:
    """The members of a group: their token union, with the members of each token."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in members]
        self.sizes = np.array([len(s) for _, s in members])
        tokens = np.concatenate([s for _, s in members])
        owners = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))

    def links(self, query: np.ndarray, num: int, den: int) -> list[int]:
        """Members with den * intersection >= num * union; nothing is opened if the token union cannot reach that."""
        at = np.searchsorted(self.union, query)
        at = np.minimum(at, len(self.union) - 1)
        at = at[self.union[at] == query]
        if den * len(at) < num * len(query):
            return []
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(self.owners[places], minlength=len(self.ids))
        good = den * shared >= num * (self.sizes + len(query) - shared)
        return [self.ids[i] for i in np.flatnonzero(good & (shared > 0))]


def open_groups(rows: DataFrame, num: int, den: int, inside: bool = False) -> DataFrame:
    """Links ``(a, b)`` of ``(grp, salt, is_query, rec, tokens)``: each query against the members of its group.

    Members of a group come before its queries and stay in memory (a bounded number); queries stream past them.
    inside: there are no other queries than the members, which travel once.
    """
    dealt = rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "is_query")

    def within(members):
        if len(members) > 1:
            group, forest = Group(list(members.items())), Forest()
            for rec, tokens in members.items():
                yield from ((rec, other) for other in group.links(tokens, num, den) if other != rec and forest.join(rec, other))

    def links(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        key, members, group, forest = None, {}, None, Forest()
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "salt", "is_query", "rec")]
            for grp, salt, is_query, rec, tokens in zip(*columns, batch.column("tokens"), strict=True):
                if key != (grp, salt):
                    if inside:
                        found += within(members)
                    key, members, group, forest = (grp, salt), {}, None, Forest()
                if not is_query:
                    members[rec] = np.frombuffer(tokens.as_py(), np.uint64)
                    continue
                if group is None:
                    if not members:
                        continue
                    group = Group(list(members.items()))
                for other in group.links(np.frombuffer(tokens.as_py(), np.uint64), num, den):
                    if other != rec and forest.join(rec, other):
                        found.append((rec, other))
            yield links(found)
        if inside:
            yield links(list(within(members)))

    return map_arrow(dealt.select("grp", "salt", "is_query", "rec", "tokens"), run, "a long, b long")


def least_shared(n: Column, num: int, den: int) -> Column:
    """Rare tokens that a set of n tokens shares with any that is linked to it, the smaller of the two having n."""
    return F.least(F.lit(SHARED), F.ceil(n * num / den))


def as_links(known: DataFrame) -> DataFrame:
    """Links that connect what ``known`` has in one component."""
    return known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def with_component(matrix: DataFrame, known: DataFrame) -> DataFrame:
    told = matrix.join(known.withColumnRenamed("node", "rec"), "rec", "left")
    return cut(told.select("token", "rec", "n", "grp", F.coalesce("component", "rec").alias("comp")), "told")


def probed(docs: DataFrame, grouped: DataFrame, members: DataFrame, probes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of probes ``(rec, grp)`` with the ``members`` ``(grp, rec)`` of their groups, by whole sets."""
    asked = probes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("salts"))
    first = members.join(asked, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_query"), "rec")
    queries = probes.join(asked, "grp").select("grp", F.pmod(F.xxhash64("rec"), F.col("salts")).alias("salt"), F.lit(True).alias("is_query"), "rec")
    return open_groups(full_sets(docs, grouped, first.unionByName(queries), k), num, den)


def pivot_links(docs: DataFrame, grouped: DataFrame, matrix: DataFrame, known: DataFrame, step: int, k: int, num: int, den: int) -> DataFrame:
    """Links of records with pivots of another component, a pivot being the record of a token with the least hash.

    A family of near copies shares its rare tokens, and so a few pivots, which most of it are linked with: what is left
    for the search by groups is few records. The hash depends on ``step``.
    """
    told = with_component(matrix, known)
    pivots = told.groupBy("token").agg(F.min(F.struct(F.xxhash64("rec", F.lit(step)), F.col("rec").alias("to"), F.col("n").alias("m"), F.col("comp").alias("c"))).alias("p")).select("token", "p.to", "p.m", "p.c")
    small = F.least("n", "m")
    fits = (F.col("comp") != F.col("c")) & (F.greatest("n", "m") * num <= small * den)
    shares = told.join(pivots, "token").where(fits).groupBy("rec", "to").agg(F.count(F.lit(1)).alias("shared"), F.min(small).alias("small"))
    probes = cut(shares.where(F.col("shared") >= least_shared(F.col("small"), num, den)).select("rec", F.col("to").alias("grp")), "probes")
    discard(told)
    members = probes.select("grp", F.col("grp").alias("rec")).distinct()
    return cut(probed(docs, grouped, members, probes, k, num, den), "links")


def record_links(docs: DataFrame, records: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between records ``(rec, doc_id, h, n, kind, prefix, b0..)`` that connect all pairs of similarity num / den or more."""
    kinds = cut(records.groupBy("kind").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "kinds")
    block = F.pmod(F.xxhash64("rec"), F.ceil(F.col("size") / GROUP))
    grouped = cut(records.join(kinds, "kind", "left").withColumn("size", F.coalesce("size", F.lit(1))).withColumn("grp", F.xxhash64("kind", block)), "grouped")
    tokens = grouped.select("rec", "n", "grp", F.explode("prefix").alias("token"))
    # a window over all rows of a token: the rows are exchanged once
    ends = Window.partitionBy("token")
    matrix = cut(tokens.select("token", "rec", "n", "grp", F.min("rec").over(ends).alias("low"), F.max("rec").over(ends).alias("high")).where("low <> high").select("token", "rec", "n", "grp"), "matrix")
    release(docs.sparkSession)
    # each group with itself and with the pivots of its kind
    several = grouped.where(f"size > 1 and n * {den - num} >= {num}").select("rec", "doc_id", "h", "kind", "grp", "size")
    pivots = several.where(f"size > {GROUP}").groupBy("kind").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("rec", F.lit("pivot")), F.ceil(F.col("size") / (4 * PIVOTS))) == 0, F.col("rec")))), 1, PIVOTS).alias("pivots"))
    spread = several.select("kind", "grp").distinct().join(pivots, "kind").select("grp", F.explode("pivots").alias("rec"))
    members = several.select("grp", "rec").unionByName(spread).distinct().select("grp", F.lit(0).cast("long").alias("salt"), F.lit(False).alias("is_query"), "rec")
    near = cut(open_groups(full_sets(docs, grouped, members, k), num, den, inside=True), "links")
    release(docs.sparkSession)
    # each record with the pivots of its rare tokens: one row a token and record, whatever the size of a family
    known = components(near)
    for step in range(PASSES):
        known = components(as_links(known).unionByName(pivot_links(docs, grouped, matrix, known, step, k, num, den)))
        release(docs.sparkSession)
    # queries that share rare tokens with a group of another component
    told = with_component(matrix, known)
    mixed = told.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    asks = told.join(mixed, "token")
    holds = asks.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    holds = holds.withColumnRenamed("grp", "to")
    fits = (F.col("n") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("n") * den) & (F.col("to") >= F.col("grp"))
    other = (F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp"))
    shares = asks.join(holds, "token").where(fits & other).groupBy("rec", "to").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("n", "least")).alias("small"))
    probes = cut(shares.where(F.col("shared") >= least_shared(F.col("small"), num, den)).select("rec", F.col("to").alias("grp")), "probes")
    # the bound: places that the query has and the group's union lacks
    unions = grouped.join(probes.select("grp").distinct(), "grp", "left_semi").groupBy("grp").agg(*[F.bit_or(w).alias(f"u{w}") for w in WORDS])
    lacks = sum((F.bit_count(F.col(w).bitwiseAND(F.bitwise_not(f"u{w}"))) for w in WORDS), F.lit(0))
    bounded = probes.join(grouped.select("rec", "n", *WORDS), "rec").join(unions, "grp").where((F.col("n") - lacks) * den >= F.col("n") * num)
    probes = cut(bounded.select("rec", "grp"), "open")
    discard(told)
    release(docs.sparkSession)
    return as_links(known).unionByName(probed(docs, grouped, grouped.select("grp", "rec"), probes, k, num, den))


def record_components(docs: DataFrame, k: int, num: int, den: int, one_document: bool) -> DataFrame:
    """``(uid, doc_id, h, n, component)`` of every row: component is a number of its class of records, null where n = 0.

    one_document: rows with an equal doc_id belong together; rows without one stay out.
    """
    with steps(docs.sparkSession) as stays:
        marks = signatures(docs, k, num, den)
        rows = marks.select("uid", "doc_id", "h", "n", "k1", "k2")
        some = rows.where("n > 0 and doc_id is not null" if one_document else "n > 0")
        # written, so that the joins below exchange both sides and a large group of copies can be split
        same = cut(some.groupBy("k1", "k2", "n").agg(F.min("uid").alias("rec")), "same")
        owned = cut(some.join(same, ["k1", "k2", "n"]).select("uid", "doc_id", "rec"), "owned")
        records = marks.join(same.select(F.col("rec").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("rec"), "doc_id", "h", "n", "kind", "prefix", *WORDS)
        links = record_links(docs, records, k, num, den)
        if one_document:
            ids = cut(owned.groupBy("doc_id").agg(F.min("rec").alias("a"), F.max("rec").alias("z")).where("a <> z").select("doc_id", "a"), "ids")
            links = links.unionByName(owned.join(ids, "doc_id").select("a", F.col("rec").alias("b")).distinct())
        links = cut(links, "links")
        release(docs.sparkSession)
        found = cut(components(links), "components").withColumnRenamed("node", "rec")
        placed = owned.join(found, "rec", "left").select("uid", F.coalesce("component", "rec").alias("component"))
        return stays(cut(rows.select("uid", "doc_id", "h", "n").join(placed, "uid", "left"), "placed"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for rows of docs(doc_id, text): links are Jaccard >= num / den."""
    placed = record_components(docs, k, num, den, True)
    names = cut(placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    ids = cut(placed.where("component is null and doc_id is not null").select("doc_id").distinct(), "empty")
    # an empty text's document may have other texts
    others = placed.where("component is not null").join(ids, "doc_id", "left_semi").select("doc_id", "component").distinct().join(names, "component").select("doc_id", F.col("component_id").alias("other"))
    full = placed.where("component is not null").join(names, "component").select("doc_id", "n", "component_id")
    bare = placed.where("component is null").join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("other", "doc_id").alias("component_id"))
    return full.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without near duplicates: of each class of linked texts one row stays, the smallest by (doc_id, text's hash).

    Rows are told apart by doc_id and text: equal doc_ids link nothing, rows without doc_id are compared like any other
    and stay only where no row of their class has one, and of rows that repeat one stays. Texts without words all stay.
    All columns pass.
    """
    placed = record_components(docs, k, num, den, False)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    kept = cut(placed.where("component is not null").groupBy("component").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("component", F.col("k.doc_id").alias("_d"), F.col("k.h").alias("_h")), "kept")
    met = cut(placed.join(kept, "component").select("doc_id", "h", same_text(F.col("doc_id"), F.col("_d"), F.col("h"), F.col("_h")).alias("stays")), "met")
    key = lambda df: df.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    lost = key(met.where("not stays").distinct())
    twice = cut(key(met.where("stays").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "twice")
    rows = docs.withColumn("_own", F.xxhash64("text"))
    this = same_text(F.col("doc_id").cast("long"), F.col("_d"), F.col("_own"), F.col("_h"))
    out = rows.join(lost, this, "left_anti")
    if twice.count():
        out = out.join(twice, this, "left_anti").unionByName(out.join(twice, this, "left_semi").dropDuplicates(["doc_id", "_own"]))
    return out.drop("_own")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, num=9, den=10)
