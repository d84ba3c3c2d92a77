"""Hard-negative mining (operator 12): bounds along a spanning tree of the anchors.

Scores are integer inner products of quantised vectors. Anchors are dealt to groups, and each group has a minimum spanning
tree by distance. A candidate's score at an anchor differs from that at the anchor's parent by at most the length of the edge
times the candidate's norm, so the parent's score (or the interval known for it) bounds the child's. Only candidates whose
interval meets a window that the anchor still wants something of are scored again, all others pass the interval on.

The windows of a first run are the whole line, for the positives (the best rows of the same label); those of a second run
are the shares of each positive's score that make a negative hard. A window that has found enough moves its lower end up.

Anchors are a stated query set against all rows, in blocks: rows and anchors are sent to pairs of (anchor group, row group),
and a task reads its anchors first and then streams the rows past them, so it holds one group of anchors and one
batch of rows. Each pair answers with at most as many rows a window as are wanted.

Rows with a null id, label or vector, or with any null or non-finite component take no part. Of rows with one id the
least (label, vector) counts. Shorter vectors are taken to be zero in the components they lack. Ties go to the smaller id. Products
beyond 2^53 are computed in whole numbers of any size; a result beyond 64 bits is an error. Other columns are not
read. Fewer rows than wanted give fewer results, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demand_engine.llm.text import keep_table

ANCHORS = 2048  # of a group, about
ROWS = 4096  # of a group, about
CHUNK = 1024  # rows that are scored at once
TASKS = 10_000  # at most; more pairs of groups share tasks
SLACK = 1e-9  # relative, on every bound, for rounding
STREAM = ["pair", "kind", "place", "parent", "edge", "vec_id", "label", "vector", "windows"]
FOUND = "anchor_id bigint, key bigint, key_score bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Settings:
    anchors: int = 50  # ids divisible by it are anchors
    relabelled: int = 7  # ids divisible by it get the next label
    labels: int = 10
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score, both ends included
    high: int = 95
    scale: int = 256
    anchor_group: int = ANCHORS
    row_group: int = ROWS


def matrix(vectors: pa.Array, scale: int, size: int = 0) -> np.ndarray:
    """Quantised vectors as rows of whole float64 numbers, at least ``size`` wide."""
    length = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    wide = max(size, int(length.max(initial=0)))
    if len(length) and (length == wide).all():
        return flat.reshape(len(length), wide)
    out = np.zeros((len(length), wide))
    out[np.arange(wide) < length[:, None]] = flat
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree from the first point: the order of joining, and each joined point's parent (place in that order) and edge length."""
    n = len(points)
    squares = (points**2).sum(1)
    near, best, place = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -1)
    order, parent, free, at = [0], [-1], np.ones(n, bool), 0
    place[0], free[0] = 0, False
    for _ in range(n - 1):
        far = squares + squares[at] - 2 * (points @ points[at])
        closer = free & (far < best)
        near[closer], best[closer] = at, far[closer]
        left = np.nonzero(free)[0]
        at = int(left[np.argmin(best[left])])
        free[at], place[at] = False, len(order)
        order.append(at)
        parent.append(int(place[near[at]]))
    order, parent = np.array(order), np.array(parent)
    edge = np.zeros(n)
    edge[1:] = np.sqrt(((points[order[1:]] - points[order[parent[1:]]]) ** 2).sum(1)) * (1 + SLACK)
    return order, parent, edge


def with_tree(scale: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        order, parent, edge = spanning_tree(matrix(table["vector"].combine_chunks(), scale))
        return table.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int32))).append_column(
            "parent", pa.array(parent.astype(np.int32))).append_column("edge", pa.array(edge))

    return run


@dataclass
class Search:
    """One group of anchors and what its windows have found so far."""

    points: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    windows: list  # of each anchor: (key, score of the key, low, high)
    wanted: int
    same: bool  # candidates are rows of the anchor's label, else of the others
    scored: int = field(default=0, init=False)  # inner products computed

    def __post_init__(self) -> None:
        n, self.most = len(self.ids), max([1, *map(len, self.windows)])
        depth = np.zeros(n, np.int64)
        for i in range(n):
            if self.parent[i] >= 0:
                depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.nonzero(depth == d)[0] for d in range(int(depth.max(initial=-1)) + 1)]
        self.low, self.high = np.full((n, self.most), np.inf), np.full((n, self.most), -np.inf)  # empty windows
        for i, listed in enumerate(self.windows):
            for w, (_, _, low, high) in enumerate(listed):
                self.low[i, w], self.high[i, w] = low, high
        self.need = self.low.copy()  # the lower end, moved up once enough is found
        self.best = np.full((n * self.most, self.wanted), -np.inf)
        self.who = np.full((n * self.most, self.wanted), np.iinfo(np.int64).max)
        self.large = False

    def go_large(self) -> None:
        """From here on whole numbers of any size instead of float64."""
        if not self.large:
            self.large = True
            whole = np.frompyfunc(lambda v: int(v) if np.isfinite(v) else v, 1, 1)
            self.points, self.best = whole(self.points), whole(self.best)
            low, high = whole(self.low), whole(self.high)
            for i, listed in enumerate(self.windows):
                for w, (_, _, a, b) in enumerate(listed):
                    low[i, w], high[i, w] = a, b
            self.low, self.high = low, high

    def add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        n, wide = len(self.ids), max(rows.shape[1], self.points.shape[1])
        rows = np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))
        if wide > self.points.shape[1]:
            self.points = np.pad(self.points, ((0, 0), (0, wide - self.points.shape[1])))
        if not self.large and np.abs(self.points).max(initial=0) * np.abs(rows).max(initial=0) * wide >= 2.0**53:
            self.go_large()
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((rows**2).sum(1)) * (1 + SLACK)
            exact = np.frompyfunc(int, 1, 1)(rows) if self.large else rows
            low, high, hits = np.zeros((len(rows), n)), np.zeros((len(rows), n)), []
            for level in self.levels:
                fits = (labels[:, None] == self.labels[level]) == self.same
                fits &= ids[:, None] != self.ids[level]
                if self.parent[level[0]] < 0:
                    ask = np.ones(fits.shape, bool)  # roots are scored for all rows
                else:
                    slack = self.edge[level] * norm[:, None]
                    slack += (slack > 0) + SLACK * slack
                    up = self.parent[level]
                    l, h = low[:, up] - slack, high[:, up] + slack
                    low[:, level], high[:, level] = l, h
                    meets = np.zeros(fits.shape, bool)
                    for w in range(self.most):  # an interval that is no number meets every window
                        meets |= ~((h < self.need[level, w]) | (l > self.high[level, w].astype(float))) & (self.need[level, w] < np.inf)
                    ask = fits & meets
                r, c = np.nonzero(ask)
                if not len(r):
                    continue
                score = self.scores(exact, level, ask, r, c)
                self.scored += len(r)
                low[r, level[c]] = high[r, level[c]] = score.astype(float)
                hits += self.wins(score, ids[r], level[c], fits[r, c])
        self.merge(hits)

    def scores(self, rows: np.ndarray, level: np.ndarray, ask: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of the asked pairs: as one product of matrices where most are asked, else pair by pair."""
        if 4 * len(r) > ask.size:
            return (rows @ self.points[level].T)[r, c]
        parts = [(rows[r[i: i + 65536]] * self.points[level[c[i: i + 65536]]]).sum(1) for i in range(0, len(r), 65536)]
        return np.concatenate(parts)

    def wins(self, score: np.ndarray, ids: np.ndarray, anchor: np.ndarray, fits: np.ndarray) -> list:
        out = []
        for w in range(self.most):
            inside = fits & (score >= self.low[anchor, w]).astype(bool) & (score <= self.high[anchor, w]).astype(bool)
            inside &= score.astype(float) * (1 + SLACK * np.sign(score.astype(float))) >= self.need[anchor, w]
            if inside.any():
                out.append((anchor[inside] * self.most + w, score[inside], ids[inside]))
        return out

    def merge(self, hits: list) -> None:
        """The best of each window, greater scores first, then smaller ids."""
        if not hits:
            return
        window, score, ids = (np.concatenate([h[i] for h in hits]) for i in range(3))
        touched = np.unique(window)
        window = np.concatenate([window, np.repeat(touched, self.wanted)])
        score = np.concatenate([score, self.best[touched].ravel()])
        ids = np.concatenate([ids, self.who[touched].ravel()])
        order = np.lexsort((ids, -score, window))
        window = window[order]
        start = np.searchsorted(window, touched)
        top = order[start[:, None] + np.arange(self.wanted)]
        self.best[touched], self.who[touched] = score[top], ids[top]
        worst = self.best[touched, -1].astype(float)
        anchor, w = np.divmod(touched, self.most)
        self.need[anchor, w] = np.maximum(self.need[anchor, w], worst - SLACK * np.abs(worst))

    def results(self) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for i, listed in enumerate(self.windows):
            for w, (key, key_score, _, _) in enumerate(listed):
                for score, who in zip(self.best[i * self.most + w], self.who[i * self.most + w]):
                    if score > -np.inf:
                        for column, value in zip(columns, (int(self.ids[i]), key, key_score, int(who), int(score))):
                            column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "key", "key_score", "vec_id", "score"])


def search_of(anchors: pa.Table, wanted: int, same: bool, s: Settings) -> Search:
    anchors = anchors.combine_chunks()
    if same:
        windows = [[(None, None, -np.inf, np.inf)]] * len(anchors)
    else:
        windows = [[(w["vec_id"], w["score"], -(-s.low * w["score"] // 100), s.high * w["score"] // 100) for w in listed or []]
                   for listed in anchors["windows"].to_pylist()]
    return Search(matrix(anchors["vector"].combine_chunks(), s.scale), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(),
                  anchors["parent"].to_numpy(), anchors["edge"].to_numpy(), windows, wanted, same)


def stream(wanted: int, same: bool, s: Settings):
    """Each pair's anchors come first, in the tree's order, then its rows, in any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, anchors, search = None, [], None
        for batch in batches:
            key = np.stack([batch["pair"].to_numpy(), batch["kind"].to_numpy()])
            cuts = [0, *(np.nonzero((np.diff(key) != 0).any(0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[0, a] != pair:
                    if search is not None:
                        yield search.results()
                    pair, anchors, search = key[0, a], [], None
                if key[1, a] == 0:
                    anchors.append(part)
                    continue
                if search is None:
                    if not anchors:
                        continue  # a group of anchors can be empty
                    search, anchors = search_of(pa.Table.from_batches(anchors), wanted, same, s), []
                for i in range(0, b - a, CHUNK):
                    some = part.slice(i, CHUNK)
                    search.add(matrix(some["vector"], s.scale), some["vec_id"].to_numpy(), some["label"].to_numpy())
        if search is not None:
            yield search.results()

    return run


def searched(tree: DataFrame, rows: DataFrame, groups: int, blocks: int, wanted: int, same: bool, s: Settings) -> DataFrame:
    """The ``wanted`` best rows of every window of every anchor, with their rank."""
    pairs = groups * blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tree.withColumn("block", every(blocks)).select(
        (F.col("group") * blocks + F.col("block")).alias("pair"), F.lit(0).alias("kind"), "place", "parent", "edge", "vec_id", "label", "vector", "windows")
    right = rows.withColumn("group", every(groups)).select(
        (F.col("group") * blocks + F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).alias("pair"), F.lit(1).alias("kind"),
        F.lit(0).alias("place"), F.lit(-1).alias("parent"), F.lit(0.0).alias("edge"), "vec_id", "label", "vector",
        F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>").alias("windows"))
    tasks = min(pairs, TASKS)
    dealt = left.unionByName(right).repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "kind", "place")
    found = dealt.select(*STREAM).mapInArrow(stream(wanted, same, s), FOUND)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def taking_part(embeddings: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, label, vector), one row per id."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    used = embeddings.where(F.col("vec_id").isNotNull() & label.isNotNull() & v.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % s.relabelled == 0, (label + 1) % s.labels).otherwise(label).alias("label"), v.alias("vector"))
    return used.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")


def mine(embeddings: DataFrame, s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = keep_table(taking_part(embeddings, s), "vectors")
    anchors = rows.where(F.col("vec_id") % s.anchors == 0)
    groups = max(1, -(-anchors.count() // s.anchor_group))
    blocks = max(1, -(-rows.count() // s.row_group))
    dealt = anchors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("group"), "vec_id", "label", "vector")
    kind = rows.schema["vector"].dataType.simpleString()
    tree = keep_table(dealt.groupBy("group").applyInArrow(
        with_tree(s.scale), f"group bigint, vec_id bigint, label bigint, vector {kind}, place int, parent int, edge double"), "tree")
    none = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    best = searched(tree.withColumn("windows", none), rows, groups, blocks, s.positives, True, s)
    lists = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("windows"))
    found = searched(keep_table(tree.join(lists, "vec_id", "left"), "windows"), rows, groups, blocks, s.negatives, False, s)
    return found.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                        F.col("key_score").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
with v as (
    select cast(vec_id as bigint) id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    qualify row_number() over (partition by vec_id order by label, embedding) = 1),
pairs as (
    select a.id anchor, b.id other, a.label = b.label same, cast(list_dot_product(a.q, b.q) as bigint) score
    from v a join v b on a.id <> b.id where a.id % 50 = 0),
positive as (
    select anchor, other, score from pairs where same
    qualify row_number() over (partition by anchor order by score desc, other) <= 5)
select p.anchor anchor_id, p.other positive_id,
       cast(row_number() over (partition by p.anchor, p.other order by n.score desc, n.other) as integer) rank,
       n.other negative_id, p.score positive_score, n.score negative_score
from positive p join pairs n on n.anchor = p.anchor and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""
