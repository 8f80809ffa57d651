"""N-gram Jaccard join with set-relation skipping: components of documents whose shingle sets are alike.

1. Equal sets are one class. Each class keeps a 64-bit key and a bit map of its hashed shingles, of two bits a shingle
   about; bits that only one of two maps has bound the overlap of their sets from above.
2. Prefix index: shingles are ordered rare before common, then by hash; the first n - ceil(t n) + 1 of a set are listed.
   Lists of one set are dropped where they are made; lists of very many sets are made in parts.
3. Each set is first paired with the one set that is the smallest of most of its lists (those smallest sets of a list's
   parts with the smallest of them). Pairs that the size, position and bit map bounds allow join into families of similar
   sets. Lists are then cut into blocks of like size and family; a pair of blocks of different families is skipped whole
   when its best positions are too late, and only the other blocks give pairs. Of those, pairs become candidates that
   share so many listed shingles that the rest can make up the overlap; they merge families.
4. Answers from a similar set: the set of a family that most others were paired with leads it. Each member's texts meet
   the leader once, which answers whether the two link, and the member is kept as its difference from the leader. With
   s(A) the symmetric difference, |A & B| = |A & L| + |B & L| - |L| + |s(A) & s(B)|, so every further answer follows from
   differences. Members that link with the leader are one component and need no answers among each other; the
   others are compared with those members whose counts allow an overlap that is large enough, in blocks of differences.

Every pair that can reach the threshold is in one family, so no link is lost; no bound depends on chance.

Defined results: null, empty and wordless texts have empty sets and link with nothing; texts with fewer words than a
shingle have one; equal texts link; rows without doc_id take part but cannot name a component; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, join_hot
from .scratch import discard, lean, shared_folder, small_batches, stored
from .shingles import set_key, shingle_sets
from .textkernel import mix

SHINGLE, PERCENT = 3, 90
#: Bytes of a set's bit map, at least and at most.
LEAST_MAP, MOST_MAP = 8, 1 << 16
#: Members of a family that are compared in one block, and that meet their leader in one task.
BLOCK, MEETING = 512, 256
#: Shingles of a family that meet its leader in one task or are compared in one block, and of a block in one range of hashes, about.
BLOCK_TOKENS, RANGE_TOKENS = 2_000_000, 1 << 18
#: Documents of a counting cell from which on its lists are dealt in parts of that size, and such cells, at most (the fullest).
LIST_PART, HOT_CELLS = 50_000, 1 << 16
#: Sets that a task remembers having listed, at most.
REMEMBERED = 1 << 20
#: Sets that a list's smallest set leads from which on its family also takes in pairs with this share of the overlap.
BUSY, EASE = 32, 0.9
#: Records of the prefix index per bucket, about.
BUCKET_RECORDS = 100_000
#: Records that a task deals to buckets at a time, about.
DEALT_RECORDS = 1 << 18
RECORD = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with which sets of n and m members reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def _bit_map(tokens: np.ndarray) -> bytes:
    size = min(max(LEAST_MAP, 1 << max(len(tokens) // 4, 1).bit_length()), MOST_MAP)
    at = (tokens >> np.uint64(20)) & np.uint64(size * 8 - 1)
    bits = np.zeros(size, np.uint8)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


def _most_shared(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets of n and m shingles: each bit that only one map has stands for a shingle that only its set has."""
    most = np.minimum(n, m)
    lengths = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for p, q in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == (p, q)).all(axis=1))
        size = min(p, q)
        # the bits of a larger map fold onto those of a smaller one
        a, b = (np.bitwise_or.reduce(np.frombuffer(b"".join(v[k] for k in at), np.uint8).reshape(len(at), -1, size), axis=1) for v in (x, y))
        only_a, only_b = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (a & ~b, b & ~a))
        most[at] = np.minimum(n[at] - only_a, m[at] - only_b)
    return most


def _described(docs: DataFrame, size: int, cell_bits: int, cell_block: int) -> DataFrame:
    """One pass: a row for each document (doc_id, text_hash, n, key, cells) and, for each task, how many documents have a shingle in each counting cell (a byte a cell, and how often it began anew)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << cell_bits, np.uint8)
        turns: Counter[int] = Counter()  # how often a cell's byte has begun anew
        for b in batches:
            n, keys, cells = [], [], []
            for tokens in shingle_sets(b.column("text"), size):
                n.append(len(tokens))
                keys.append(set_key(tokens))
                cells.append(_bit_map(tokens))
                hit = (tokens >> np.uint64(64 - cell_bits)).astype(np.int64)
                seen = count[hit]
                count[hit] = seen + np.uint8(1)
                if (seen == 255).any():
                    turns.update(np.unique(hit[seen == 255]).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int32()), pa.array(keys, pa.int64()), pa.array(cells, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        of_block: dict[int, list[tuple[int, int]]] = {}
        for cell, times in sorted(turns.items()):
            of_block.setdefault(cell // cell_block, []).append((cell % cell_block, times))
        blocks = [k for k in range(len(count) // cell_block) if k in of_block or count[k * cell_block : (k + 1) * cell_block].any()]
        m = len(blocks)
        task = pa.array(np.full(m, TaskContext.get().partitionId(), np.int32))
        counts = pa.array([count[k * cell_block : (k + 1) * cell_block].tobytes() for k in blocks], pa.binary())
        carried = pa.array([np.array(of_block.get(k, []), "<u4").tobytes() for k in blocks], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(m, b_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), counts, pa.array(blocks, pa.int32()), task, carried], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    b_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = ["doc_id", "text_hash", "n", "key", "cells", "block", "task", "turns"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(work), f"doc_id {kind}, text_hash long, n int, key long, cells binary, block int, task int, turns binary")


def _common(described: DataFrame, folder: str, cell_bits: int, cell_block: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the cells that hold common shingles (twice the mean load and 64 documents, counted over all), and the fullest cells with their counts."""
    least = 64 + 2 * total // (1 << cell_bits)

    def added(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                count = np.zeros(cell_block, np.uint32)
                for part in b.column("parts")[k].as_py():
                    one = np.frombuffer(part["cells"], "<u4" if level else np.uint8).astype(np.uint32)
                    if not level:
                        cell, times = np.frombuffer(part["turns"], "<u4").reshape(-1, 2).T
                        one[cell] += times * np.uint32(256)
                    count += np.minimum(one, np.uint32(0xFFFFFFFF) - count)
                block = b.column("block").slice(k, 1)
                if level < 2:
                    yield pa.RecordBatch.from_arrays([block, b.column("task").slice(k, 1), pa.array([count.tobytes()], pa.binary())], names=["block", "task", "cells"])
                    continue
                full = np.flatnonzero(count >= LIST_PART)
                yield pa.RecordBatch.from_arrays([block, pa.array([np.packbits(count >= least).tobytes()], pa.binary()), pa.array([full.tolist()], pa.list_(pa.int64())), pa.array([count[full].tolist()], pa.list_(pa.int64()))], names=["block", "bits", "full", "counts"])

    # counts of 64 tasks are added, then those of 64 such groups, then what is left: 200 rows of 64 KB for 800,000 tasks
    some = described.where("block is not null").select("block", "task", F.struct("cells", "turns").alias("part"))
    for level in (0, 1):
        summed = some.groupBy("block", F.shiftright("task", 6).alias("task")).agg(F.collect_list("part").alias("parts"))
        some = summed.mapInArrow(lean(partial(added, level=level)), "block int, task int, cells binary").select("block", "task", F.struct("cells").alias("part"))
    last = some.groupBy("block").agg(F.collect_list("part").alias("parts"))
    whole = stored(last.mapInArrow(lean(partial(added, level=2)), "block int, bits binary, full array<long>, counts array<long>"), folder, "cells")
    rows = whole.select("block", "bits").collect()  # 2^cell_bits bits
    bits = np.zeros((1 << cell_bits) // 8, np.uint8)
    for r in rows:
        bits[r["block"] * cell_block // 8 : (r["block"] + 1) * cell_block // 8] = np.frombuffer(r["bits"], np.uint8)
    full = whole.select("block", F.explode(F.arrays_zip("full", "counts")).alias("x")).select((F.col("block").cast("long") * cell_block + F.col("x.full")).alias("cell"), F.col("x.counts").alias("count"))
    hot = sorted((r["cell"], r["count"]) for r in full.orderBy(F.desc("count"), "cell").limit(HOT_CELLS).collect())
    return bits, np.array([c for c, _ in hot], np.int64), np.array([-(-n // LIST_PART) for _, n in hot], np.int64)


def _lists(docs: DataFrame, size: int, percent: int, common: np.ndarray, hot: np.ndarray, parts: np.ndarray, cell_bits: int, buckets: int) -> DataFrame:
    """Lists of the prefix index that hold more than one set: token, key, n, pos and the list's smallest set. Lists of hot cells come in parts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        out, held = [], 0  # over several batches: rows of few records would cost more than these
        for b in batches:
            if len(done) > REMEMBERED:
                done.clear()
            for tokens in shingle_sets(b.column("text"), size):
                n = len(tokens)
                if not n or (key := set_key(tokens)) in done:
                    continue
                done.add(key)
                cell = (tokens >> np.uint64(64 - cell_bits)).astype(np.int64)
                frequent = (common[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                prefix = np.concatenate([tokens[~frequent], tokens[frequent]])[: n + (-percent * n // 100) + 1]
                r = np.empty(len(prefix), RECORD)
                r["token"], r["key"], r["n"], r["pos"] = prefix, key, n, np.arange(len(prefix))
                out.append(r)
                held += len(r)
                if held >= DEALT_RECORDS:
                    yield dealt_out(np.concatenate(out))
                    out, held = [], 0
        if out:
            yield dealt_out(np.concatenate(out))

    def dealt_out(r: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(r["token"] + mix(part_of(r)) * np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in np.split(r[order], at[1:])], pa.binary())], names=["bucket", "records"])

    def part_of(r: np.ndarray) -> np.ndarray:
        """0 for lists that are whole, else the part from 1 on."""
        part = np.zeros(len(r), np.uint64)
        if len(hot):
            cell = (r["token"] >> np.uint64(64 - cell_bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
            dealt = hot[at] == cell
            part[dealt] = mix(r["key"][dealt].view(np.uint64)) % parts[at[dealt]].astype(np.uint64) + np.uint64(1)
        return part

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = np.frombuffer(b"".join(b.column("parts")[k].as_py()), RECORD)
                part = part_of(r)
                order = np.lexsort((r["key"], r["n"], part, r["token"]))
                r, part = r[order], part[order]
                new = np.append(True, (r["token"][1:] != r["token"][:-1]) | (part[1:] != part[:-1]))
                keep = new.copy()
                keep[1:] |= r["key"][1:] != r["key"][:-1]
                r, part = r[keep], part[keep]
                starts = np.flatnonzero(new[keep])
                lengths = np.diff(np.append(starts, len(r)))
                first = np.repeat(starts, lengths)
                many = np.repeat(lengths > 1, lengths) | (part > 0)
                r, lead, part = r[many], r[first[many]], part[many]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["token"].view(np.int64)), pa.array(r["key"]), pa.array(r["n"]), pa.array(r["pos"]), pa.array(lead["key"]), pa.array(lead["n"]), pa.array(lead["pos"]), pa.array(part > 0)],
                    names=["token", "key", "n", "pos", "lead", "lead_n", "lead_pos", "dealt"],
                )

    packed = docs.select("text").mapInArrow(lean(emit), "bucket long, records binary")
    return packed.groupBy("bucket").agg(F.collect_list("records").alias("parts")).mapInArrow(lean(gather), "token long, key long, n int, pos int, lead long, lead_n int, lead_pos int, dealt boolean")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bit maps allow the overlap they need, or the share ``ease`` of it; pairs is a stored table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy().astype(np.int64), batch.column("m").to_numpy().astype(np.int64)
            most = _most_shared(batch.column("x").to_pylist(), batch.column("y").to_pylist(), n, m)
            keep = pa.array(most >= least_overlap(n, m, percent) * batch.column("ease").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    one = classes.select(F.col("key").alias("a"), F.col("n"), F.col("cells").alias("x"))
    two = classes.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("cells").alias("y"))
    return join_hot(join_hot(pairs, one, "a"), two, "b").select("a", "b", "n", "m", "x", "y", "ease").mapInArrow(lean(work), "a long, b long")


def _needs(n: str, m: str, percent: int):  # noqa: ANN202
    return F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / (100 + percent) - F.lit(1e-9))


def _across(lists: DataFrame, families: DataFrame, folder: str, percent: int) -> DataFrame:
    """Candidate pairs of different families, by blocks of the lists.

    With k the share t of the larger set, shared shingles at positions up to n - k and m - k are all listed. What two sets
    share beyond the earlier end of these positions is less than k, so that sets which need an overlap of k + x have more
    than x such shingles in common. Blocks go by a hash of their token, size and family; should two share one, that adds candidates.
    """

    def own(n: str, m: str):  # noqa: ANN202
        return F.ceil(F.lit(percent) * F.greatest(n, m) / 100 - F.lit(1e-9))

    rows = lists.select("token", "key", "n", "pos").join(families.select(F.col("node").alias("key"), F.col("root").alias("family")), "key", "left").withColumn("family", F.coalesce("family", "key"))
    # stored, so that the lists are joined with their families once and not for each of their three uses
    rows = stored(rows.withColumn("size", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")), folder, "rows")
    discard(lists.sparkSession, folder, "lists")  # nothing reads them any more
    blocks = stored(rows.groupBy("token", "size", "family").agg(F.min("pos").alias("pos"), F.max("n").alias("most"), F.min("n").alias("least")), folder, "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    token = F.col("x.token") == F.col("y.token")
    late = F.least(F.col("x.most") - F.col("x.pos"), F.col("y.most") - F.col("y.pos")) >= own("x.least", "y.least")
    ends = [F.xxhash64(*[F.col(f"{side}.{c}") for c in ("token", "size", "family")]).alias(name) for side, name in (("x", "one"), ("y", "two"))]
    # three of the four sides of these joins are dealt alike, and move once
    level = x.join(y, token & (F.col("x.size") == F.col("y.size"))).where((F.col("x.family") < F.col("y.family")) & late).select(ends)
    above = x.join(y, token & (F.col("x.size") + 1 == F.col("y.size"))).where((F.col("x.family") != F.col("y.family")) & late).select(ends)
    pairs = level.unionByName(above)
    block = F.xxhash64("token", "size", "family")
    one = rows.select(block.alias("one"), F.col("key").alias("a"), "n", "pos")
    two = rows.select(block.alias("two"), F.col("key").alias("b"), F.col("n").alias("m"), F.col("pos").alias("p"))
    return (
        pairs.join(one, "one")
        .join(two, "two")
        .where("a <> b")
        .where(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("p")) >= own("n", "m"))
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(_needs("n", "m", percent) - own("n", "m")).alias("beyond"))
        .where(F.col("shared") > F.col("beyond"))
        .select("a", "b", F.lit(1.0).alias("ease"))
    )


def _overlapping(keys: list[int], n: np.ndarray, base: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members of n shingles; two overlap in base + base + the overlap of their differences ``sets``."""
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    # one range of hashes at a time: sorting all tokens of a block at once takes ten times their own memory
    ranges = max(1, -(-sum(map(len, sets)) // RANGE_TOKENS))
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = np.stack([np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets])
    width = 2048
    for at in range(ranges):
        row = np.repeat(np.arange(len(sets), dtype=np.int32), cuts[:, at + 1] - cuts[:, at])
        _, column, count = np.unique(np.concatenate([s[c[at] : c[at + 1]] for s, c in zip(sets, cuts, strict=True)]), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [k, k + width])
            part = np.zeros((len(sets), min(width, int(column[-1]) + 1 - k)), np.float32)
            part[row[lo:hi], column[lo:hi] - k] = 1
            overlap += part @ part.T
    linked = np.stack([overlap[k] + base[k] + base >= least_overlap(n[k], n, percent) for k in range(len(sets))])
    label, forest = np.full(len(sets), -1), []
    for start in range(len(sets)):
        if label[start] < 0:
            label[start], front = start, [start]
            while front:
                x = front.pop()
                for y in np.flatnonzero(linked[x] & (label < 0)):
                    label[y] = start
                    forest.append((keys[x], keys[y]))
                    front.append(int(y))
    return forest


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return linked_rows(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and the component's own key ``root`` (null for empty sets) for every row."""
    spark = small_batches(docs).sparkSession
    folder = shared_folder(spark)
    cell_block = 1 << 14
    characters = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    cell_bits = int(np.clip(np.ceil(np.log2(max(characters, 1) / 256)), 16, 26))
    described = stored(_described(docs, size, cell_bits, cell_block), folder, "described")
    rows = described.where("block is null")
    classes = stored(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("cells").alias("cells")), folder, "classes")
    total = classes.select(F.sum(F.col("n").cast("long"))).first()[0] or 0
    common, hot, parts = _common(described, folder, cell_bits, cell_block, total)
    buckets = max(64, total * (100 - percent) // 100 // BUCKET_RECORDS)
    lists = stored(_lists(docs, size, percent, common, hot, parts, cell_bits, buckets), folder, "lists")

    similar, edges = _families(lists, classes, folder, percent)
    families = stored(components(edges, f"{folder}/second"), folder, "families")
    discard(spark, folder, "first", "second")
    links = _links(docs, classes, families, similar, folder, size, percent)
    roots = stored(components(links, f"{folder}/third"), folder, "roots")
    known = stored(classes.select("key", "doc_id").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")), folder, "known")
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    table = stored(join_hot(known, least, "root").select("key", "root", "component_id"), folder, "table")
    discard(spark, folder, "families", "similar", "across", "met", "links", "third", "roots", "known", "classes")
    return join_hot(rows, table, "key", "left").select("doc_id", "text_hash", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def _families(lists: DataFrame, classes: DataFrame, folder: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets with their lists' smallest sets, and all edges that make families."""
    reach = F.least(F.col("n") - F.col("pos"), F.col("lead_n") - F.col("lead_pos")) >= _needs("n", "lead_n", percent)
    of_list = lists.where("key <> lead").select("key", "n", "pos", "lead", "lead_n", "lead_pos")
    heads = lists.where("dealt and key = lead").select("token", F.struct("n", "key", "pos").alias("head"))  # one row a part of a hot list
    lowest = heads.groupBy("token").agg(F.min("head").alias("low"))
    of_parts = heads.join(lowest, "token").where("head.key <> low.key").select("head.key", "head.n", "head.pos", F.col("low.key").alias("lead"), F.col("low.n").alias("lead_n"), F.col("low.pos").alias("lead_pos"))
    stars = (
        of_list.unionByName(of_parts)
        .where(F.col("lead_n") * 100 >= F.col("n") * percent)
        .groupBy(F.col("key").alias("a"), F.col("lead").alias("b"))
        .agg(F.bool_or(reach).alias("reach"), F.count("*").alias("lists"))
        .groupBy("a")
        .agg(F.max_by(F.struct("b", "reach"), F.struct("lists", "b")).alias("best"))
        .select("a", "best.b", "best.reach")
    )
    stars = stored(stars, folder, "stars")
    # around a set that leads many others, pairs are cheaper to count in blocks than to list: such families take in looser kin
    busy = stars.groupBy("b").agg(F.count("*").alias("kin")).where(F.col("kin") >= BUSY)
    eased = stored(join_hot(stars, busy, "b", "left").where("reach or kin is not null").select("a", "b", F.when(F.col("kin").isNotNull(), EASE).otherwise(1.0).alias("ease")), folder, "eased")
    similar = stored(_possible(eased, classes, percent), folder, "similar")
    first = stored(components(similar, f"{folder}/first"), folder, "families1")
    pairs = stored(_across(lists, first, folder, percent), folder, "pairs")
    across = stored(_possible(pairs, classes, percent), folder, "across")
    discard(lists.sparkSession, folder, "stars", "eased", "rows", "blocks", "pairs")
    return similar.unionByName(across), first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across)


def _links(docs: DataFrame, classes: DataFrame, families: DataFrame, similar: DataFrame, folder: str, size: int, percent: int) -> DataFrame:
    """Links that join the sets of each component, counted exactly."""
    ends = similar.select(F.col("a").alias("node")).unionByName(similar.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("kin"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    members = stored(
        families.join(classes.select(F.col("key").alias("node"), number.alias("doc"), F.col("n").cast("long").alias("n")), "node").join(ends, "node", "left").select("node", "root", "doc", "n", F.coalesce("kin", F.lit(0)).alias("kin")),
        folder,
        "members",
    )
    heads = members.groupBy("root").agg(F.max(F.struct("kin", "node")).alias("top"), F.count("*").alias("members"), F.sum("n").alias("tokens")).select("root", F.col("top.node").alias("leader"), "members", F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.ceil(F.col("members") / MEETING)).cast("int").alias("parts"))
    dealt = (
        join_hot(members, heads, "root")
        .withColumn("leads", F.col("node") == F.col("leader"))
        .withColumn("part", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))))
        .select("node", "root", "members", "leads", "part")
    )
    met = stored(_met(docs, members, dealt, size, percent), folder, "met")
    links = stored(met.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(_among(met, folder, percent)), folder, "links")
    discard(docs.sparkSession, folder, "members", "among")
    return links


def _met(docs: DataFrame, members: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Each member against its family's leader: root, leader, node, n, shared, outside (shingles of either that the other lacks), linked, and in families of more than two the difference itself.

    Only texts that stand for a member are read again; a family's members are dealt over tasks and pass through them one
    after the other, each part behind the leader's text.
    """
    n = members.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * 16)), 10, 26))
    hashed = members.select(F.pmod(F.xxhash64("doc"), F.lit(1 << bits)).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(32)).cast("int"))
    words = hashed.groupBy(F.shiftright("h", 5).alias("word")).agg(F.bit_or(bit).alias("mask")).toPandas()  # 2^21 rows at most
    wanted = np.zeros((1 << bits) // 32, np.int64)
    wanted[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            h = b.column("h").to_numpy()
            b = b.filter(pa.array((wanted[h >> 5] >> (h & 31) & 1).astype(bool)))
            keys = [set_key(s) for s in shingle_sets(b.column("text"), size)]
            new = []
            for key in keys:
                new.append(key not in done)
                done.add(key)
            if len(done) > REMEMBERED:
                done.clear()
            new = pa.array(new, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).filter(new), b.column("text").filter(new)], names=["node", "text"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader, lead, before = None, 0, np.zeros(0, np.uint64), None
        for b in batches:
            out: dict[str, list] = {name: [] for name in names}
            columns = [b.column(c).to_pylist() for c in ("root", "part", "node", "leads", "members")]
            for root, part, node, leads, count, tokens in zip(*columns, shingle_sets(b.column("text"), size), strict=True):
                if leads:
                    at, leader, lead = (root, part), node, tokens
                elif (root, part, node) != before:
                    if at != (root, part):
                        raise RuntimeError(f"the leader of family {root} is missing")
                    place = np.minimum(np.searchsorted(lead, tokens), len(lead) - 1)
                    hit = lead[place] == tokens
                    missing = np.ones(len(lead), bool)
                    missing[place[hit]] = False
                    shared = int(hit.sum())
                    linked = shared >= least_overlap(np.int64(len(lead)), np.int64(len(tokens)), percent)
                    far = np.sort(np.concatenate([tokens[~hit], lead[missing]])).tobytes() if count > 2 else None
                    for name, value in zip(names, (root, leader, node, len(tokens), shared, len(lead) - shared + len(tokens) - shared, bool(linked), len(lead), far), strict=True):
                        out[name].append(value)
                before = (root, part, node)
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(names, kinds, strict=True)], names=names)

    names = ["root", "leader", "node", "n", "shared", "outside", "linked", "lead_n", "difference"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    texts = docs.select("text", F.pmod(F.xxhash64(number), F.lit(1 << bits)).alias("h")).mapInArrow(lean(named), "node long, text string")
    placed = texts.join(dealt, "node").repartition("root", "part").sortWithinPartitions("root", "part", F.desc("leads"), "node")
    return placed.select("root", "part", "node", "leads", "members", "text").mapInArrow(lean(meet), "root long, leader long, node long, n long, shared long, outside long, linked boolean, lead_n long, difference binary")


def _among(met: DataFrame, folder: str, percent: int) -> DataFrame:
    """Links of members that do not link with their leader, by differences; pairs that the counts rule out are left out."""
    own = F.col("n") - F.col("shared")
    apart = ~F.col("linked")
    bounds = (
        met.where("difference is not null")
        .groupBy("root")
        .agg(
            F.count_if(apart).alias("apart"), F.max("shared").alias("shared_any"), F.max(own).alias("own_any"), F.min("n").alias("n_any"),
            F.max(F.when(apart, F.col("shared"))).alias("shared_apart"), F.max(F.when(apart, own)).alias("own_apart"), F.min(F.when(apart, F.col("n"))).alias("n_apart"),
        )
        .where("apart > 0")
    )
    most = lambda other: F.least("shared", f"shared_{other}") + F.least(own, F.col(f"own_{other}"))
    able = F.when(apart, most("any") >= _needs("n", "n_any", percent)).otherwise(most("apart") >= _needs("n", "n_apart", percent))
    open_ = stored(join_hot(met.where("difference is not null"), bounds, "root").where(able).select("root", "node", "n", (F.col("shared") - F.col("lead_n") / 2).alias("base"), "linked", "outside", "difference"), folder, "among")
    parts = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.col("outside"))), F.lit(0)) / BLOCK_TOKENS)).cast("int")
    sizes = open_.groupBy("root").agg(parts(apart).alias("p"), parts(F.col("linked")).alias("q"), F.count("*").alias("open")).where("p > 0 and open > 1")
    placed = join_hot(open_, sizes, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.when(apart, F.col("p")).otherwise(F.col("q"))).cast("int"))
    # blocks of members apart meet each other (right = i) and blocks of linked ones (right = -1 - i)
    with_apart = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(F.least("i", j).alias("left"), F.greatest("i", j).alias("right")))
    with_linked = F.when(F.col("q") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("q"), F.lit(1)) - 1), lambda j: F.struct(F.col("i").alias("left"), (-1 - j).alias("right")))).otherwise(F.array().cast("array<struct<left:int,right:int>>"))
    of_linked = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(j.alias("left"), (-1 - F.col("i")).alias("right")))
    grouped = (
        placed.withColumn("to", F.explode(F.when(apart, F.concat(with_apart, with_linked)).otherwise(of_linked)))
        .groupBy("root", "to")  # 2 BLOCK rows and 2 BLOCK_TOKENS shingles a group, about
        .agg(F.sort_array(F.collect_list(F.struct("node", "n", "base", "difference"))).alias("m"))
        .select("m")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forest: list[tuple[int, int]] = []
            for k in range(b.num_rows):
                nodes, n, base, far = b.column("m")[k].values.flatten()
                forest += _overlapping(nodes.to_pylist(), n.to_numpy(), base.to_numpy(), [np.frombuffer(t.as_buffer(), np.uint64) for t in far], percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in forest], pa.int64()), pa.array([c for _, c in forest], pa.int64())], names=["a", "b"])

    return grouped.mapInArrow(lean(verify), "a long, b long")
