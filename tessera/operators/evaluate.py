"""Agreement of clusterings with labels: tables ``(id, pred, label)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.gaussian import squared_distance
from tessera.lineage import cut, ship


def contingency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pred", "label").agg(F.count(F.lit(1)).alias("n"))


def assembled(features: DataFrame, labels: DataFrame, preds: DataFrame) -> DataFrame:
    """``(id, features, label, pred, lacks)`` of tables by id; lacks names what an id has no row of, else it is empty."""
    tables = {"features": features, "label": labels, "pred": preds}
    out = None
    for name, table in tables.items():
        one = table.select("id", name, F.lit(True).alias(f"_{name}"))
        out = one if out is None else out.join(one, "id", "full_outer")
    lacks = F.concat_ws(",", *[F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in tables])
    return out.select("id", *tables, lacks.alias("lacks"))


def bundle(rows: DataFrame, d: int) -> DataFrame:
    """All measures of ``(id, pred, label, features)`` as one row."""
    out = agreement(rows)
    for one in (purity(rows), misclassification(rows), ari(rows), nmi(rows), calinski_harabasz(rows, d)):
        out = out.crossJoin(one)
    return out


def contingency_matrix(rows: DataFrame, labels: list[int]) -> DataFrame:
    return rows.groupBy("pred").pivot("label", labels).count().na.fill(0)


def cluster_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row: the percentage of rows whose two assignments are equal."""
    return rows.agg((F.avg((F.col("pred") == F.col("label")).cast("double")) * 100).alias("agreement"))


def purity(rows: DataFrame) -> DataFrame:
    most = contingency(rows).groupBy("pred").agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    return most.agg((F.sum("most") / F.sum("size")).alias("purity"))


def majority_map(rows: DataFrame) -> DataFrame:
    """``(label, pred)``: the most frequent prediction of each label, the smaller on ties."""
    return contingency(rows).groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("minus"), "pred")).alias("b")).select("label", "b.pred")


def relabelled(rows: DataFrame) -> DataFrame:
    """rows with pred translated to labels by the majority map; a later label wins a conflict; unmapped ones stay."""
    back = majority_map(rows).groupBy("pred").agg(F.max("label").alias("_to"))
    return rows.join(F.broadcast(back), "pred", "left").select(*[c for c in rows.columns if c != "pred"], F.coalesce("_to", "pred").alias("pred"))


def per_class(rows: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1)`` of predictions that use the labels' names."""
    table = contingency(rows)
    hit = table.where("pred = label").select("label", F.col("n").alias("tp"))
    out = table.groupBy("label").agg(F.sum("n").alias("true")).join(hit, "label", "left").join(table.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said")), "label", "left")
    tp, eps = F.coalesce("tp", F.lit(0)), F.lit(1e-9)
    out = out.withColumn("precision", tp / (F.coalesce("said", F.lit(0)) + eps)).withColumn("recall", tp / (F.col("true") + eps))
    return out.select("label", "precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)).alias("f1"))


def misclassification(rows: DataFrame) -> DataFrame:
    """One row: misclassification rate and macro F1."""
    return rows.agg((1 - F.avg((F.col("pred") == F.col("label")).cast("double"))).alias("mcr")).crossJoin(per_class(rows).agg(F.avg("f1").alias("macro_f1")))


def _pairs(n):
    return n * (n - 1) / 2


def ari(rows: DataFrame) -> DataFrame:
    """Adjusted Rand index, from the contingency table."""
    table = contingency(rows)
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    side = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("s")).agg(F.sum(_pairs(F.col("s"))).alias(name))
    one = cells.crossJoin(side("pred", "a")).crossJoin(side("label", "b"))
    expected = F.col("a") * F.col("b") / _pairs(F.col("n"))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / (most - expected)).alias("ari"))


def nmi(rows: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies)."""
    table = contingency(rows)
    total = table.agg(F.sum("n").cast("double").alias("t"))
    p = table.groupBy("pred").agg(F.sum("n").alias("np"))
    q = table.groupBy("label").agg(F.sum("n").alias("nl"))
    mutual = table.join(p, "pred").join(q, "label").crossJoin(total).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("np") * F.col("nl")))).alias("mi"))
    entropy = lambda df, c, name: df.crossJoin(total).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(name))
    one = mutual.crossJoin(entropy(p, "np", "hp")).crossJoin(entropy(q, "nl", "hl"))
    return one.select(F.when(F.col("hp") + F.col("hl") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hp") + F.col("hl"))).alias("nmi"))


def calinski_harabasz(rows: DataFrame, d: int) -> DataFrame:
    """Between to within variance of clusters, of rows with features and pred: one aggregation per cluster."""
    xs = [F.get("features", i) for i in range(d)]
    per = rows.groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in xs]).alias("mean"), sum((F.var_pop(x) for x in xs), F.lit(0.0)).alias("spread"))
    whole = rows.agg(F.array(*[F.avg(x) for x in xs]).alias("centre"))
    one = per.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared_distance(F.col("mean"), F.col("centre"))).alias("between"), F.sum(F.col("n") * F.col("spread")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return one.select((F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


#: Tiles that a silhouette's points are dealt to unless they get too large; points times clusters of a tile.
TILES, CELLS = 24, 1 << 20


class _Tile:
    """Points of a tile with their summed distances to each cluster; of points with an id also how many rows have that id."""

    def __init__(self, clusters: np.ndarray, pred: np.ndarray, x: np.ndarray, rows: np.ndarray, who: np.ndarray, known: np.ndarray):
        self.clusters, self.at, self.x, self.rows, self.who, self.known = clusters, np.searchsorted(clusters, pred), x, rows, who, known
        self.xx = (x * x).sum(axis=1)
        self.lifted = np.column_stack([x, self.xx, np.ones(len(x))])
        self.totals, self.own = np.zeros((len(x), len(clusters))), np.zeros((len(x), len(clusters)), np.int64)

    def meet(self, pred: np.ndarray, x: np.ndarray, rows: np.ndarray, who: np.ndarray, known: np.ndarray, wide: int = 1024, high: int = 64) -> None:
        """Add the distances to other points, in pieces that stay in the processor's cache."""
        for j in range(0, len(x), wide):
            there = slice(j, min(j + wide, len(x)))
            y, times, q = np.ascontiguousarray(x[there].T), rows[there].astype(float), np.searchsorted(self.clusters, pred[there])
            yy = (y * y).sum(axis=0)
            lifted = np.vstack([-2 * y, np.ones(len(q)), yy])
            ends = np.append(np.flatnonzero(q[1:] != q[:-1]) + 1, len(q)).tolist()
            spans = list(zip([0, *ends], ends, strict=False))
            far = np.empty((high, len(q)))
            for i in range(0, len(self.x), high):
                here = slice(i, min(i + high, len(self.x)))
                piece = far[: here.stop - i]
                np.matmul(self.lifted[here], lifted, out=piece)
                self.refine(piece, self.x[here], y, 1e-6 * (self.xx[here].max() + yy.max()))
                np.sqrt(piece, out=piece)
                own = self.known[here, None] & known[there] & (self.who[here, None] == who[there]) if known[there].any() else None
                if own is not None:
                    piece[own] = 0
                for begin, end in spans:
                    self.totals[here, q[begin]] += piece[:, begin:end] @ times[begin:end]
                    if own is not None:
                        self.own[here, q[begin]] += own[:, begin:end] @ rows[there][begin:end]

    @staticmethod
    def refine(squares: np.ndarray, x: np.ndarray, y: np.ndarray, poor: float) -> None:
        """Small squared distances lose their digits in a product of matrices: those are made from differences."""
        if np.isfinite(poor) and squares.min() > poor:
            return
        i, j = np.nonzero(~(squares > poor))
        if np.isfinite(poor) and len(i) * 8 < squares.size:
            squares[i, j] = ((x[i] - y.T[j]) ** 2).sum(axis=1)
            return
        squares[:] = 0
        for k in range(len(y)):
            squares += (x[:, k, None] - y[k]) ** 2

    def score(self, sizes: np.ndarray) -> float:
        """The summed silhouettes of the tile's ids; sizes: rows of each cluster."""
        n = sizes - self.own
        n[~self.known, self.at[~self.known]] -= 1
        mine = np.arange(len(self.clusters)) == self.at[:, None]
        sums, times, ids = self.totals, self.rows, np.arange(len(n))
        if self.known.any():
            # rows with one id and cluster have one mean, and the id the largest or least of them
            place = np.arange(len(n))
            keys, unit = np.unique(np.column_stack([self.known, np.where(self.known, self.who, place), np.where(self.known, self.at, 0)]), axis=0, return_inverse=True)
            weight = np.where(self.known, self.rows, 1)[:, None]
            sums, counts, first, times = np.zeros((len(keys), len(sizes))), np.zeros((len(keys), len(sizes)), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
            np.add.at(sums, unit, self.totals * weight)
            np.add.at(counts, unit, n * weight)
            first[unit] = place
            times[unit] = np.where(self.known, 1, self.rows)
            n, mine, ids = counts, mine[first], np.unique(keys[:, :2], axis=0, return_inverse=True)[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            means = sums / n
            a, b = np.full(ids.max() + 1, -np.inf), np.full(ids.max() + 1, np.inf)
            np.maximum.at(a, ids, np.where(mine & (n > 0), means, -np.inf).max(axis=1))
            np.minimum.at(b, ids, np.where(~mine & (n > 0), means, np.inf).min(axis=1))
            last = np.ones(len(a), np.int64)
            last[ids] = times
            s = np.where((a == -np.inf) | (b == np.inf), 0, (b - a) / np.maximum(a, b))
        return float((s * last).sum())


def silhouette(rows: DataFrame, d: int, block: int = 1 << 17) -> DataFrame:
    """Mean silhouette (Euclidean), exact, of any number of rows ``(id, pred, features)``: the first d features count.

    Rows without an id do not count; an id without a cluster or one of its features has the silhouette 0 and is in no
    other's mean; distances between rows of one id are left out; of fewer than two ids the result is null.

    Rows of one cluster and place are one point with a number of rows. The distances of all pairs of points are the
    definition, so the work is quadratic. Points are dealt to tiles of at most ``block``, and all points stream past
    each tile: a task holds one tile, a point travels once a tile (some ``TILES`` times), and a tile gives one row.
    """
    ship(rows.sparkSession)
    named = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("pred").cast("long").alias("pred"), F.transform(F.slice("features", 1, d), lambda v: v.cast("double")).alias("x"))
    again = cut(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    repeats = again.agg(F.sum(F.col("n") - 1).alias("n")).first()["n"] or 0
    ids = named.count() - repeats
    whole = named.where(f"pred is not null and size(x) = {d} and not exists(x, v -> v is null)")
    owned = whole.join(again.select("id", F.col("id").alias("who")), "id", "left") if repeats else whole.withColumn("who", F.lit(None).cast("long"))
    points = cut(owned.groupBy("pred", "x", "who").agg(F.count(F.lit(1)).alias("rows")), "points")
    per = sorted(points.groupBy("pred").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("points"), F.array(*[F.sum(F.get("x", k)) for k in range(d)]).alias("sums")).collect())
    count = sum(r["points"] for r in per)
    clusters, sizes = (np.array([r[c] for r in per], np.int64) for c in ("pred", "rows"))
    centre = np.array([r["sums"] for r in per], float).reshape(-1, d).sum(axis=0) / max(count, 1)
    side = min(max(-(-count // TILES), 256), block, max(1, CELLS // max(1, len(per))))
    tiles = max(1, -(-count // side))

    def run(batches):
        key, members, tile = None, [], None
        for batch in batches:
            at, pred, times, who = (np.asarray(batch.column(c).fill_null(0)) for c in ("tile", "pred", "rows", "who"))
            known, other = np.asarray(batch.column("who").is_valid()), np.asarray(batch.column("other"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, d) - centre
            change = np.flatnonzero((at[1:] != at[:-1]) | (other[1:] != other[:-1])) + 1
            for begin, end in zip([0, *change], [*change, len(at)], strict=True):
                if begin == end:
                    continue
                if key != at[begin]:
                    if tile:
                        yield pa.RecordBatch.from_arrays([pa.array([tile.score(sizes)])], ["s"])
                    key, members, tile = at[begin], [], None
                part = [v[begin:end] for v in (pred, x, times, who, known)]
                if not other[begin]:
                    members.append(part)
                    continue
                if members:
                    tile, members = _Tile(clusters, *map(np.concatenate, zip(*members, strict=True))), []
                if tile:
                    tile.meet(*part)
        if tile:
            yield pa.RecordBatch.from_arrays([pa.array([tile.score(sizes)])], ["s"])

    # an id's rows are in one tile
    home = F.pmod(F.when(F.col("who").isNull(), F.xxhash64("pred", "x")).otherwise(F.xxhash64("who")), F.lit(tiles)).cast("int")
    mine = points.select(home.alias("tile"), F.lit(False).alias("other"), "pred", "x", "rows", "who")
    others = points.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(True).alias("other"), "pred", "x", "rows", "who")
    dealt = mine.unionByName(others).repartitionByRange(tiles, "tile").sortWithinPartitions("tile", "other", "pred")
    sums = dealt.mapInArrow(run, "s double").agg(F.sum("s").alias("s"))
    return sums.select(F.when(F.lit(ids > 1), F.coalesce("s", F.lit(0.0)) / F.lit(float(max(ids, 1)))).alias("silhouette"))


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in the assignment of least cost (square matrix, O(K^3)): shortest augmenting paths."""
    n = len(cost)
    row_price, col_price, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for row in range(n):
        reach, via, seen = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        now, column = row, -1
        while True:
            slack = np.where(seen, np.inf, cost[now] - row_price[now] - col_price)
            base = 0.0 if column < 0 else reach[column]
            better = ~seen & (base + slack < reach)
            reach[better], via[better] = base + slack[better], column
            column = int(np.argmin(np.where(seen, np.inf, reach)))
            seen[column] = True
            if owner[column] < 0:
                break
            now = owner[column]
        end = reach[column]
        for c in np.flatnonzero(seen):
            if c != column:
                row_price[owner[c]] += end - reach[c]
                col_price[c] -= end - reach[c]
        row_price[row] += end
        while column >= 0:
            before = via[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    out = [0] * n
    for c, r in enumerate(owner):
        out[r] = c
    return out


def best_mapping(rows: DataFrame, k: int) -> dict[int, int]:
    """pred to label, the one-to-one mapping with most agreement; the K x K table is solved on the driver."""
    table = np.zeros((k, k))
    for r in contingency(rows).collect():
        table[r["pred"], r["label"]] = r["n"]
    return dict(enumerate(hungarian(-table)))
