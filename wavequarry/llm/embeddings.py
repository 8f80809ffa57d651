"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= c is distance <= sqrt(2 - 2c). Equal vectors are one class.
Classes are dealt to blocks by their nearest pivot and the distance from it; each block holds a cover tree, whose levels
are nested and halve their radii. Two trees are descended together, level by level: a pair of nodes further apart than the
sum of their covering radii and the threshold is dropped; a pair whose every members are within the threshold is linked
whole; the others are replaced by their children. What is left at the leaves is compared in double precision.

Pairs of blocks are dropped before any vector is sent where some pivot is further from all of one block than from all of
the other by more than the threshold. A block pair gives link counts and a spanning forest of its links, never all pairs;
components follow from the forests. In data without low-dimensional structure neither bound prunes near the roots, and the
comparisons between top nodes, done as matrix products, grow with the square of the distinct vectors.

Defined results: null, zero and empty vectors and those with null or non-finite components link with nothing and
are kept; vectors of different length do not link; rows with equal vectors link with each other; a row without
vec_id takes part but cannot name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, join_hot
from .scratch import discard, shared_folder, stored

COSINE = 0.95
#: Classes of a block, about, and shells around a pivot that its blocks are made of.
BLOCK, SHELLS = 8192, 64
#: Vectors from which pivots are chosen, and pivots, at most.
PIVOT_SAMPLE, PIVOTS = 1024, 64
#: Levels end at this radius; smaller nodes are leaves.
LEAF_RADIUS = 1 / 32
#: Rounding of distances got from products.
SLACK = 1e-7
#: Nodes whose distances are taken at a time, and rows from which centres are chosen at a time.
TILE, CHUNK = 1024, 256


@dataclass
class Tree:
    """By level: the row at the centre of each node, the node of each row, and each node's covering radius."""

    centres: list[np.ndarray]
    labels: list[np.ndarray]
    radii: list[np.ndarray]

    def __post_init__(self) -> None:
        self.order = [np.argsort(label, kind="stable") for label in self.labels]
        self.starts = [np.searchsorted(label[o], np.arange(len(c) + 1)) for label, o, c in zip(self.labels, self.order, self.centres, strict=True)]
        parents = [above[below] for above, below in zip(self.labels, self.centres[1:], strict=False)]
        self.child_order = [np.argsort(p, kind="stable") for p in parents]
        self.child_starts = [np.searchsorted(p[o], np.arange(len(c) + 1)) for p, o, c in zip(parents, self.child_order, self.centres, strict=False)]

    def depth(self, level: int) -> int:
        return min(level, len(self.centres) - 1)

    def start(self) -> int:
        """The deepest level of no more than twice the nodes of the first: where radii are small and pairs are not many more."""
        few = [k for k, c in enumerate(self.centres) if len(c) <= 2 * len(self.centres[self.depth(1)])]
        return few[-1]

    def members(self, level: int, node: int) -> np.ndarray:
        return self.order[level][self.starts[level][node] : self.starts[level][node + 1]]

    def children(self, level: int, node: int) -> np.ndarray:
        """Nodes of the next level; a node of the last level stays."""
        if level == len(self.centres) - 1:
            return np.array([node])
        return self.child_order[level][self.child_starts[level][node] : self.child_starts[level][node + 1]]


def cover_tree(x: np.ndarray) -> Tree:
    """Each node's first child has its own centre; the others cover what that child does not, greedily by row order."""
    n = len(x)
    single_precision = x.astype(np.float32)
    centre, label, radius = np.zeros(1, np.int64), np.zeros(n, np.int64), 2.0
    tree = ([], [], [])
    while True:
        d = np.sqrt(((x - x[centre[label]]) ** 2).sum(axis=1))
        order = np.argsort(label, kind="stable")
        starts = np.searchsorted(label[order], np.arange(len(centre) + 1))
        for part, got in zip(tree, (centre, label, np.maximum.reduceat(d[order], starts[:-1])), strict=True):
            part.append(got)
        if radius <= LEAF_RADIUS or len(centre) == n:
            return Tree(*tree)
        radius /= 2
        single = np.diff(starts) == 1
        below = list(centre[single])
        next_label = np.empty(n, np.int64)
        next_label[centre[single]] = np.arange(len(below))
        for node in np.flatnonzero(~single):
            left = order[starts[node] : starts[node + 1]]
            near = d[left] <= radius
            next_label[left[near]] = len(below)
            below.append(centre[node])
            _cover(single_precision, left[~near], radius, next_label, below)
        centre, label = np.array(below), next_label


def _cover(x: np.ndarray, left: np.ndarray, radius: float, label: np.ndarray, centres: list) -> None:
    """Covers rows greedily in their order: the first one that is not covered becomes the next centre."""
    least = np.float32(1 - radius * radius / 2)
    while len(left):
        head, left = left[:CHUNK], left[CHUNK:]
        near = x[head] @ x[head].T >= least
        covered = np.zeros(len(head), bool)
        first = len(centres)
        chosen = []
        for k in range(len(head)):
            if not covered[k]:
                new = near[k] & ~covered
                new[k] = True
                label[head[new]] = len(centres)
                centres.append(head[k])
                chosen.append(k)
                covered |= new
        if len(left):
            near = x[left] @ x[head[chosen]].T >= least
            at = near.argmax(axis=1)
            hit = near[np.arange(len(left)), at]
            label[left[hit]] = first + at[hit]
            left = left[~hit]


def linked(x: np.ndarray, tx: Tree, y: np.ndarray, ty: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row lists all of whose pairs link, each pair of rows once (for a block with itself: both ways, and each row with itself)."""
    reach = np.sqrt(2 - 2 * cosine)
    i, j = tx.start(), ty.start()
    tops = _tiles(x[tx.centres[i]], y[ty.centres[j]], tx.radii[i] + reach, ty.radii[j])
    while True:
        rx, ry = tx.radii[i], ty.radii[j]
        left = []
        for a, b in tops:
            for k in range(0, len(a), 1 << 14):
                p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                d = np.sqrt(((x[tx.centres[i][p]] - y[ty.centres[j][q]]) ** 2).sum(axis=1))
                bound = rx[p] + ry[q]
                whole = d + bound <= reach - SLACK
                for s, t in zip(p[whole], q[whole], strict=True):
                    yield tx.members(i, s), ty.members(j, t)
                open_ = ~whole & (d <= bound + reach + SLACK)
                left.extend(zip(p[open_], q[open_], strict=True))
        if i == len(tx.centres) - 1 and j == len(ty.centres) - 1:
            for s, t in left:
                m, n = tx.members(i, s), ty.members(j, t)
                r, c = np.nonzero(x[m] @ y[n].T >= cosine)
                for k in np.unique(r):
                    yield m[k : k + 1], n[c[r == k]]
            return
        down = [(tx.children(i, s), ty.children(j, t)) for s, t in left]
        if not down:
            return
        tops = [(np.concatenate([np.repeat(u, len(v)) for u, v in down]), np.concatenate([np.tile(v, len(u)) for u, v in down]))]
        i, j = tx.depth(i + 1), ty.depth(j + 1)


def _tiles(x: np.ndarray, y: np.ndarray, reach_x: np.ndarray, reach_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of top nodes no further apart than their reaches together (and a few more), by matrix products in single precision.

    Nodes of like reach share a tile, so that one bound serves all pairs of two tiles.
    """
    p, q = np.argsort(reach_x, kind="stable"), np.argsort(reach_y, kind="stable")
    x, y = x[p].astype(np.float32), y[q].astype(np.float32)

    def cuts(reach: np.ndarray) -> list[int]:
        steps = reach[0] + np.array([0.0, 0.03, 0.06, 0.12, 0.25, 0.5, 1.0])
        return sorted({*range(0, len(reach), TILE), *np.searchsorted(reach, steps, side="right").tolist(), len(reach)})

    of_x, of_y = cuts(reach_x[p]), cuts(reach_y[q])
    for k, k_end in zip(of_x, of_x[1:], strict=False):
        for m, m_end in zip(of_y, of_y[1:], strict=False):
            reach = reach_x[p[k_end - 1]] + reach_y[q[m_end - 1]]
            hit = np.flatnonzero(x[k:k_end] @ y[m:m_end].T >= np.float32(1 - reach * reach / 2 - 1e-5))
            if len(hit):
                yield p[k + hit // (m_end - m)], q[m + hit % (m_end - m)]


def _unit(blob: bytes, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(blob, kind).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _planted(side: dict) -> Tree:
    n = len(side["copies"])
    labels = np.frombuffer(side["tree"], np.int32).reshape(-1, n).astype(np.int64)
    centres = np.split(np.frombuffer(side["centres"], np.int32).astype(np.int64), np.cumsum(labels.max(axis=1) + 1)[:-1])
    radii = np.split(np.frombuffer(side["radii"], np.float64), np.cumsum(labels.max(axis=1) + 1)[:-1])
    return Tree(centres, list(labels), radii)


def _pair(left: dict, right: dict, kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of both blocks (copies counted), and a spanning forest of the links over their joint rows."""
    same = left["block"] == right["block"]
    x = _unit(left["vectors"], left["dim"], kind)
    y = x if same else _unit(right["vectors"], right["dim"], kind)
    tx = _planted(left)
    ty = tx if same else _planted(right)
    copies = np.concatenate([left["copies"], right["copies"]])
    n = len(x)
    shift = 0 if same else n
    links = np.zeros(n + len(y), np.int64)
    parent = np.arange(n + len(y))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    forest: list[tuple[int, int]] = []
    for m, o in linked(x, tx, y, ty, cosine):
        o = o + shift
        links[m] += copies[o].sum()
        if not same:
            links[o] += copies[m].sum()
        hub = root(int(m[0]))
        for k in (*m[1:], *o):
            if (r := root(int(k))) != hub:
                parent[r] = hub
                forest.append((int(m[0]), int(k)))
    return links, np.array(forest, np.int64).reshape(-1, 2)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    v = F.col("v")
    finite = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")).withColumn("class", F.when(finite, F.concat_ws("", F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), F.col("v"))))))
    classes = stored(rows.where("class is not null").groupBy("class").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies")), folder, "classes")
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # vector lengths in use
    pivots = {d: _pivots(classes, d, n, kind) for d, n in dims.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, away = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            length = b.column("dim").to_numpy()
            values = b.column("v")
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                x = _unit(np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in at]).astype(kind).tobytes(), int(d), kind)
                cosines = x @ pivots[d].T
                home[at] = cosines.argmax(axis=1)
                away[at] = np.sqrt(np.maximum(2 - 2 * cosines.max(axis=1), 0))
            blobs = [flat[offsets[k] : offsets[k + 1]].astype(kind).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("rep"), b.column("copies"), b.column("dim"), pa.array(home), pa.array(away), pa.array(blobs, pa.binary())], names=["class", "rep", "copies", "dim", "home", "away", "blob"])

    id_type = dict(rows.dtypes)["id"]
    homes = stored(classes.withColumn("dim", F.size("v")).select("class", "rep", "copies", "dim", "v").mapInArrow(deal, f"class string, rep {id_type}, copies long, dim int, home long, away double, blob binary"), folder, "homes")
    # distances that are alike are told apart by a billionth of the row's hash
    away = F.col("away") + F.pmod(F.xxhash64("class"), F.lit(1 << 20)) * 1e-15
    cuts = F.percentile_approx(away, [k / SHELLS for k in range(1, SHELLS)], 2000).alias("cuts")
    sizes = homes.groupBy("dim", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), cuts)  # PIVOTS rows a length
    shell = F.size(F.filter("cuts", lambda c: c < away))
    spread = F.greatest(F.ceil(F.col("parts") / SHELLS), F.lit(1)).cast("long")  # blocks of one shell
    part = F.when(F.col("parts") <= SHELLS, F.floor(shell * F.col("parts") / SHELLS)).otherwise(shell * spread + F.pmod(F.xxhash64("class"), spread))
    dealt = homes.join(F.broadcast(sizes), ["dim", "home"]).withColumn("part", part.cast("long"))
    gathered = (
        dealt.groupBy("dim", "home", "part")  # about BLOCK rows a group
        .agg(F.sort_array(F.collect_list(F.struct("class", "rep", "copies", "blob"))).alias("m"))
        .select("dim", F.pmod(F.xxhash64("dim", "home", "part"), F.lit(1 << 40)).alias("block"), F.col("m.class").alias("class"), F.col("m.rep").alias("rep"), F.col("m.copies").alias("copies"), F.col("m.blob").alias("blobs"))
    )

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                dim = b.column("dim")[k].as_py()
                x = _unit(b"".join(b.column("blobs")[k].as_py()), dim, kind)
                tree = cover_tree(x)
                away = np.sqrt(np.maximum(2 - 2 * (x @ pivots[dim].T), 0))
                ranges = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (away.min(axis=0), away.max(axis=0))]
                flat = [np.stack(tree.labels).astype(np.int32).tobytes(), np.concatenate(tree.centres).astype(np.int32).tobytes(), np.concatenate(tree.radii).tobytes()]
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, *[pa.array([f], pa.binary()) for f in flat], *ranges], names=[*b.schema.names, "tree", "centres", "radii", "nearest", "farthest"])

    blocks = stored(gathered.mapInArrow(plant, f"dim int, block long, class array<string>, rep array<{id_type}>, copies array<long>, blobs array<binary>, tree binary, centres binary, radii binary, nearest array<double>, farthest array<double>"), folder, "blocks")
    fields = ("block", "dim", "copies", "blobs", "tree", "centres", "radii")
    side = blocks.select(*fields)
    ids = blocks.select("dim", "block", "nearest", "farthest")  # a row a block
    # the distance from a pivot differs by no more than the distance between two vectors
    gap = F.array_max(F.zip_with("l.nearest", "r.farthest", lambda p, q: p - q)), F.array_max(F.zip_with("r.nearest", "l.farthest", lambda p, q: p - q))
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    pairs = ids.alias("l").join(ids.alias("r"), (F.col("l.dim") == F.col("r.dim")) & (F.col("l.block") <= F.col("r.block")) & (F.greatest(*gap) <= reach)).select(F.col("l.block").alias("left"), F.col("r.block").alias("right"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = side.select(F.col("block").alias("left"), F.struct(*fields).alias("x"))
    right = side.select(F.col("block").alias("right"), F.struct(*fields).alias("y"))
    work = pairs.join(left, "left").join(right, "right").repartition(max(parts, 24), "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = (s | {"copies": np.array(s["copies"], np.int64), "vectors": b"".join(s["blobs"])} for s in (batch.column("x")[k].as_py(), batch.column("y")[k].as_py()))
                links, forest = _pair(one, other, kind, cosine)
                n = len(one["copies"])
                name = np.concatenate([one["block"] * (1 << 20) + np.arange(n), other["block"] * (1 << 20) + np.arange(len(other["copies"]))])
                has = np.flatnonzero(links)
                a = np.concatenate([name[has], name[forest[:, 0]]])
                b = np.concatenate([np.full(len(has), -1), name[forest[:, 1]]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([links[has], np.zeros(len(forest), np.int64)]))], names=["a", "b", "links"])

    found = stored(work.mapInArrow(compare, "a long, b long, links long"), folder, "found")
    linked_to = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b >= 0").select("a", "b"), folder)
    members = blocks.select("block", F.posexplode(F.arrays_zip("class", "rep")).alias("at", "m")).select((F.col("block") * (1 << 20) + F.col("at")).alias("node"), F.col("m.class").alias("class"), F.col("m.rep").alias("rep"))
    known = members.join(linked_to, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known, folder, "known")
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    table = stored(join_hot(known, least, "root").select("class", "links", "component"), folder, "table")
    discard(spark, folder, "classes", "homes", "blocks", "found", "known")
    # a class links with its own copies too: links counts the row itself, which is taken off
    return join_hot(rows, table, "class", "left").select(
        F.col("id").alias(id_col),
        F.greatest(F.coalesce(F.col("links"), F.lit(1)) - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def _pivots(classes: DataFrame, dim: int, n: int, kind: str) -> np.ndarray:
    """Farthest-first pivots of a bounded sample; they steer the dealing alone, not the result."""
    sample = classes.where(F.size("v") == dim).orderBy("class").limit(PIVOT_SAMPLE).select("v").collect()
    x = _unit(np.array([r["v"] for r in sample]).astype(kind).tobytes(), dim, kind)
    chosen = [0]
    near = x @ x[0]
    for _ in range(1, min(PIVOTS, max(1, n // BLOCK), len(x))):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]
