"""Hard negatives by an R-tree packed by sort-tile-recursion.

Scores are inner products of whole numbers (x = floor(256 * c), see `vectors`).
The rows are dealt out by ranges of (label, first coordinates), the first sort
of the packing; a slab is a part of this, of about ROWS rows. A task takes one
slab and one block of anchors, goes on packing the slab's rows of each label
into leaves coordinate by coordinate, and builds boxes upwards. For an anchor,
a box gives an interval of inner products, coordinate by coordinate; a queue
opens boxes in the order of the interval's upper end and drops those that end
below the best rows' last or lie outside every score window. The best rows of
the slabs are merged by anchor; of each slab at most PLACES come.

First the positives: the trees of the anchor's own label. Then all windows of
an anchor at once, one for each different positive score, over the trees of
the other labels. Every anchor meets every slab in its block, so memory is that
of a slab and a block, whatever the size of the table.

Of rows equal in label and x only the PLACES + 1 smallest ids go into the tree:
the others come after them in every answer. This is a limit of rank by key that
Spark applies before it shuffles, so that copies of one vector don't meet in
one task.

Rows without id, label or a whole vector take no part (see `vectors`); of rows
of one id that of the smallest (label, x) stands. Ties are in the order of ids.
An anchor without positives, or a positive without negatives, gives no rows;
nor does an empty table. Scores beyond a long are told apart but given as null.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise
from .vectors import EXACT, matrix, quantised

ROWS, BLOCK, LEAF, FANOUT, PLACES = 8192, 4096, 128, 16, 5
#: A negative's score is at least this share of the positive's, in percent.
LOW = 80


def pack(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: sorted and cut by one coordinate after the other, those of greater variance first."""
    spread = x.astype(float).var(axis=0)
    dims = np.argsort(-spread, kind="stable")

    def cut(rows: np.ndarray, dims: np.ndarray) -> Iterator[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            yield rows
            return
        # as many coordinates as it takes to halve at each
        k = max(1, min(len(dims), int(np.ceil(np.log2(leaves)))))
        slabs = leaves if k == 1 else int(np.ceil(leaves ** (1 / k)))
        size = leaf * -(-leaves // slabs)
        rows = rows[np.argsort(x[rows, dims[0]], kind="stable")]
        for i in range(0, len(rows), size):
            yield from cut(rows[i : i + size], dims[1:] if len(dims) > 1 else dims)

    return list(cut(np.arange(len(x)), dims))


class Tree:
    """Rows of one label: leaves and boxes above them up to one root."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        leaves = pack(x, leaf)
        self.rows = [(ids[r], x[r]) for r in leaves]
        low, high = [x[r].min(axis=0) for r in leaves], [x[r].max(axis=0) for r in leaves]
        self.below: list[range | None] = [None] * len(leaves)
        level = range(len(leaves))
        while len(level) > 1:
            start = len(low)
            for i in range(level.start, level.stop, fanout):
                part = range(i, min(i + fanout, level.stop))
                low.append(np.min([low[k] for k in part], axis=0))
                high.append(np.max([high[k] for k in part], axis=0))
                self.below.append(part)
            level = range(start, len(low))
        self.low, self.high = np.array(low), np.array(high)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each box allows each anchor."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Best:
    """The first PLACES rows of a window of scores, by falling score, then by id."""

    def __init__(self, least: int | None = None, most: int | None = None):
        self.least, self.most, self.found = least, most, []

    def floor(self):
        """Below this no row is wanted; None: any is."""
        last = -self.found[-1][0] if len(self.found) >= PLACES else None
        return last if self.least is None else self.least if last is None else max(self.least, last)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = np.ones(len(ids), bool) if self.most is None else scores <= self.most
        floor = self.floor()
        if floor is not None:
            fit &= scores >= floor
        where = np.flatnonzero(fit)
        if len(where) > PLACES:
            where = where[np.lexsort((ids[where], -scores[where]))[:PLACES]] if scores.dtype != object else sorted(where, key=lambda i: (-scores[i], ids[i]))[:PLACES]
        for i in where:
            insort(self.found, (-int(scores[i]), int(ids[i])))
        del self.found[PLACES:]


def search(trees: list[tuple[Tree, np.ndarray, np.ndarray]], place: int, anchor: np.ndarray, own: int, wanted: list[Best]) -> None:
    """Best-first over the trees, each with the intervals of a block of anchors; own: an id that is left out."""
    queue = [(-high[place, -1], t, len(tree.low) - 1) for t, (tree, _, high) in enumerate(trees)]
    heapq.heapify(queue)
    while queue:
        upper, t, node = heapq.heappop(queue)
        floors = [w.floor() for w in wanted]
        if all(f is not None and -upper < f for f in floors):
            break  # what is left in the queue ends lower still
        tree, low, high = trees[t]
        if not any((f is None or -upper >= f) and (w.most is None or low[place, node] <= w.most) for w, f in zip(wanted, floors, strict=True)):
            continue
        if tree.below[node] is not None:
            for k in tree.below[node]:
                heapq.heappush(queue, (-high[place, k], t, k))
            continue
        ids, x = tree.rows[node]
        scores = x @ anchor
        if (ids == own).any():
            scores, ids = scores[ids != own], ids[ids != own]
        for w in wanted:
            w.add(ids, scores)


def _numbers(x: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all sums are exact in them, else as Python's integers."""
    most = max((int(max(a.max(), -int(a.min()))) for a in (x, anchors) if a.size), default=0)
    kind = float if most * most * max(1, x.shape[1]) < EXACT else object
    return x.astype(kind), anchors.astype(kind)


def _trees(left: pa.Table, x: np.ndarray, anchors: np.ndarray) -> dict[int, tuple[Tree, np.ndarray, np.ndarray]]:
    label, ids = left["label"].to_numpy(), left["vec_id"].to_numpy()
    out = {}
    for k in np.unique(label):
        tree = Tree(ids[label == k], x[label == k])
        out[int(k)] = (tree, *tree.intervals(anchors))
    return out


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of the anchors' own label in a slab."""
    out: list[tuple] = []
    if len(left) and len(right):
        x, anchors = _numbers(matrix(left["x"]), matrix(right["x"]))
        trees = _trees(left, x, anchors)
        for i, (a, label) in enumerate(zip(right["vec_id"].to_pylist(), right["label"].to_pylist(), strict=True)):
            if label in trees:
                best = Best()
                search([trees[label]], i, anchors[i], a, [best])
                out += [(a, b, str(-s)) for s, b in best.found]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"anchor_id": pa.array(columns[0], pa.int64()), "positive_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.string())})


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of other labels in a slab, for each window of each anchor."""
    out: list[tuple] = []
    if len(left) and len(right):
        x, anchors = _numbers(matrix(left["x"]), matrix(right["x"]))
        trees = _trees(left, x, anchors)
        for i, (a, label, windows) in enumerate(zip(right["vec_id"].to_pylist(), right["label"].to_pylist(), right["windows"].to_pylist(), strict=True)):
            # a window is empty where the positive's score is negative
            wanted = {s: Best(-(-LOW * s // 100), s) for s in sorted({int(w) for w in windows if int(w) >= 0}, reverse=True)}
            if wanted:
                search([t for k, t in trees.items() if k != label], i, anchors[i], a, list(wanted.values()))
                out += [(a, str(s), b, str(-n)) for s, best in wanted.items() for n, b in best.found]
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({"anchor_id": pa.array(columns[0], pa.int64()), "window": pa.array(columns[1], pa.string()), "negative_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.string())})


#: Scores travel as text, since they may be longer than a long, and are ordered as numbers.
SCORE = "decimal(38,0)"


def prepared(table: DataFrame) -> DataFrame:
    """vec_id, label (after the shift of ids divisible by 7), x: one row for each id."""
    rows = quantised(table.where("vec_id IS NOT NULL AND label IS NOT NULL"), "embedding", "vec_id", "label")
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(shifted.alias("label"), "x").alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.x")


def slabs(rows: DataFrame, per_slab: int = ROWS) -> tuple[DataFrame, int]:
    """The rows that can be among the first PLACES of an answer, with their slab, and the number of slabs."""
    copies = Window.partitionBy("label", "x").orderBy("vec_id")
    first = materialise(rows.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= PLACES + 1).drop("_r"))
    parts = max(1, -(-first.count() // per_slab))
    order = [F.col("label"), *(F.try_element_at("x", F.lit(i)) for i in (1, 2)), F.col("vec_id")]
    packed = materialise(first.repartitionByRange(parts, *order).withColumn("slab", F.spark_partition_id()))
    return packed, (packed.agg(F.max("slab")).first()[0] or 0) + 1


def _met(packed: DataFrame, queries: DataFrame, blocks: int, f: Callable, schema: str) -> DataFrame:
    """f of each slab and each block of the queries that go there."""
    left = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # both sides come from one table: named anew, their keys can be told apart
    left, queries = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, queries))
    return left.groupBy("slab", "block").cogroup(queries.groupBy("slab", "block")).applyInArrow(f, schema)


def mine(table: DataFrame, every: int = 100, per_slab: int = ROWS, per_block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, whose ids `every` divides."""
    rows = materialise(prepared(table))
    packed, n_slabs = slabs(rows, per_slab)
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // per_block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    there = packed.select("slab", "label").distinct()
    near = _met(packed, anchors.join(there, "label"), blocks, _positives, "anchor_id long, positive_id long, score string")
    place = Window.partitionBy("anchor_id").orderBy(F.desc(F.col("score").cast(SCORE)), "positive_id")
    positives = materialise(near.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= PLACES).select("anchor_id", "positive_id", "score"))
    windows = positives.groupBy("anchor_id").agg(F.collect_set("score").alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1))))
    far = _met(packed, asked, blocks, _negatives, "anchor_id long, window string, negative_id long, score string")
    place = Window.partitionBy("anchor_id", "window").orderBy(F.desc(F.col("score").cast(SCORE)), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= PLACES).select("anchor_id", "window", "rank", "negative_id", F.col("score").alias("_n"))
    out = ranked.join(positives.withColumnRenamed("score", "window"), ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.expr("try_cast(window AS long)").alias("positive_score"), F.expr("try_cast(_n AS long)").alias("negative_score"))


def op13(embeddings: DataFrame) -> DataFrame:
    """One row per anchor, positive and hard negative."""
    return mine(embeddings)


SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label, CAST(list_dot_product(a.x, e.x) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {PLACES}),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE s.label <> p.own AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT * FROM n WHERE rank <= {PLACES}"""
