"""Short codes for vectors: a codebook for each part of a vector, trained by dual-tree Lloyd rounds on whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import key_of, small_join
from flowguard.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors under one set of trees, and points of a leaf.
BLOCK, LEAF = 8192, 128
#: Components stay below this, so that no squared distance leaves 64 bits.
LARGEST = 1 << 27


@lru_cache(maxsize=64)
def layout(n: int, leaf: int) -> np.ndarray:
    """Nodes of a balanced tree over n places as (start, end, first of two neighbouring children or -1), parents first."""
    nodes, at = [(0, n, -1)], 0
    while at < len(nodes):
        start, end, _ = nodes[at]
        if end - start > leaf:
            nodes[at] = (start, end, len(nodes))
            middle = (start + end) // 2
            nodes += [(start, middle, -1), (middle, end, -1)]
        at += 1
    return np.array(nodes)


class Tree:
    """Points in an order in which every node is a range, with the box and the sum of each node."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, leaf: int):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums
        self.start, self.end, self.child = layout(len(points), leaf).T
        self.width = (high - low).max(axis=1, initial=0)

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int) -> Tree:
        """Splits every node at the middle of the dimension in which it is widest."""
        nodes, order = layout(len(points), leaf), np.arange(len(points))
        low, high = (np.zeros((len(nodes), points.shape[1]), np.int64) for _ in range(2))
        for i, (start, end, child) in enumerate(nodes):
            inside = points[order[start:end]]
            low[i], high[i] = inside.min(axis=0), inside.max(axis=0)
            if child >= 0:
                axis = int(np.argmax(high[i] - low[i])) if points.shape[1] else 0
                order[start:end] = order[start:end][np.argpartition(inside[:, axis], (start + end) // 2 - start)]
        placed = points[order]
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), placed.cumsum(axis=0)])
        return cls(order, placed, low, high, running[nodes[:, 1]] - running[nodes[:, 0]], leaf)

    def packed(self) -> list[bytes]:
        """Buffers for a table: places and points in 32 bits, sums in 64."""
        return [a.astype(kind).tobytes() for a, kind in zip((self.order, self.points, self.low, self.high, self.sums),
                                                            (np.int32, np.int32, np.int32, np.int32, np.int64), strict=True)]

    @classmethod
    def unpacked(cls, buffers: list[bytes], width: int, leaf: int) -> Tree:
        order = np.frombuffer(buffers[0], np.int32)
        points, low, high = (np.frombuffer(b, np.int32).reshape(-1, width).astype(np.int64) for b in buffers[1:4])
        return cls(order, points, low, high, np.frombuffer(buffers[4], np.int64).reshape(-1, width), leaf)


class Book:
    """A codebook as a tree of single entries; of equal entries only the first can be nearest."""

    def __init__(self, entries: np.ndarray):
        distinct, first = np.unique(entries, axis=0, return_index=True)
        self.tree = Tree.grow(distinct, 1)
        self.index = np.full(len(self.tree.child), -1)
        leaves = self.tree.child < 0
        self.index[leaves] = first[self.tree.order[self.tree.start[leaves]]]

    def assign(self, data: Tree, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every point in tree order, then counts and sums of the `size` entries.

        Pairs of a data node and a book node are descended together, the wider side first. A book node is dropped if even
        its nearest corner is farther than the farthest corner of another one, or, once single entries are left, if one
        of them is nearer all over the data node's box. A data node with one entry left is taken whole by its stored sum;
        leaves with several compare whole-number distances, ties to the lower index.
        """
        tree, codes = self.tree, np.zeros(len(data.points), np.int64)
        counts, sums = np.zeros(size, np.int64), np.zeros((size, data.points.shape[1]), np.int64)
        stack = [(0, np.zeros(1, np.int64))]
        while stack:
            node, near = stack.pop()
            low, high, inner = data.low[node], data.high[node], data.child[node] >= 0
            near = self._within(low, high, near)
            while True:
                open_ = tree.child[near] >= 0
                if not open_.any() or (inner and tree.width[near[open_]].max() <= data.width[node]):
                    break
                left = tree.child[near[open_]]
                near = self._within(low, high, np.concatenate([near[~open_], left, left + 1]))
            if not open_.any():
                near = self._unbeaten(low, high, near)
            start, end = data.start[node], data.end[node]
            if len(near) == 1 and not open_.any():
                entry = self.index[near[0]]
                codes[start:end] = entry
                counts[entry] += end - start
                sums[entry] += data.sums[node]
            elif inner:
                stack += [(data.child[node], near), (data.child[node] + 1, near)]
            else:
                near = near[np.argsort(self.index[near])]
                entries, points = tree.low[near], data.points[start:end]
                chosen = self.index[near[np.argmin((entries * entries).sum(axis=1) - 2 * points @ entries.T, axis=1)]]
                codes[start:end] = chosen
                counts += np.bincount(chosen, minlength=size)
                np.add.at(sums, chosen, points)
        return codes, counts, sums

    def _within(self, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> np.ndarray:
        below, above = self.tree.low[near] - high, low - self.tree.high[near]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(-below, -above)
        most = np.maximum(most, least)
        return near[(least * least).sum(axis=1) <= (most * most).sum(axis=1).min()]

    def _unbeaten(self, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Entries that are nearest somewhere in the box when compared with the one nearest to its middle."""
        entries = self.tree.low[near]
        off = 2 * entries - (low + high)
        best = int(np.argmin((off * off).sum(axis=1)))
        apart = entries - entries[best]
        farther = (entries * entries).sum(axis=1) - (entries[best] ** 2).sum() - 2 * (np.where(apart > 0, high, low) * apart).sum(axis=1)
        keep = (farther < 0) | ((farther == 0) & (self.index[near] < self.index[near[best]]))
        keep[best] = True
        return near[keep]


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    found = np.floor(vectors.astype(np.float64) * scale)
    if found.size and np.abs(found).max() >= LARGEST:
        raise ValueError(f"components must stay below {LARGEST // scale} in size")
    return found.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors must have {width} components each")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _grow_blocks(width: int, parts: int, scale: int, schema: pa.Schema, block: int, leaf: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(rows: pa.Table) -> pa.RecordBatch:
            whole = rows.combine_chunks().to_batches()[0]
            points = whole_numbers(_matrix(whole.column("v"), width), scale).reshape(len(whole), parts, width // parts)
            trees = [b for p in range(parts) for b in Tree.grow(np.ascontiguousarray(points[:, p]), leaf).packed()]
            ends = pa.array([0, len(whole)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, whole.column("id")).cast(schema.field("id").type),
                 pa.ListArray.from_arrays(ends, whole.column("label")).cast(schema.field("label").type), pa.array([trees], pa.list_(pa.binary()))],
                names=["id", "label", "trees"])
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = block - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if len(held[-1]) == room:
                    yield full(pa.Table.from_batches(held))
                    held = []
        if held:
            yield full(pa.Table.from_batches(held))
    return grow


def _trees(buffers: list[bytes], width: int, parts: int, leaf: int) -> list[Tree]:
    return [Tree.unpacked(buffers[5 * p:5 * p + 5], width // parts, leaf) for p in range(parts)]


def _totals(books: np.ndarray, leaf: int):
    """Counts and sums of all entries over the blocks of a task."""
    parts, entries, width = books.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for buffers in batch.column(0).to_pylist():
                for p, tree in enumerate(_trees(buffers, parts * width, parts, leaf)):
                    _, n, s = made[p].assign(tree, entries)
                    counts[p] += n
                    sums[p] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "sums"])
    return total


def _codes(books: np.ndarray, leaf: int, names: list[str]):
    parts, entries, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            for row, buffers in enumerate(batch.column(2).to_pylist()):
                trees = _trees(buffers, parts * width, parts, leaf)
                codes, error = np.zeros((len(trees[0].points), parts), np.uint8), np.zeros(len(trees[0].points), np.int64)
                for p, tree in enumerate(trees):
                    found = made[p].assign(tree, entries)[0]
                    off = tree.points - books[p][found]
                    codes[tree.order, p] = found
                    error[tree.order] += (off * off).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.slice(row, 1).flatten(), labels.slice(row, 1).flatten(), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                                                  pa.array(error)], names=names)
    return code


def train(blocks: DataFrame, books: np.ndarray, rounds: int, leaf: int = LEAF) -> np.ndarray:
    """The codebooks (parts, entries, width) after the rounds; only counts and sums of entries leave the tasks."""
    width = books.shape[2]
    for _ in range(rounds):
        sums = [F.sum(F.get("sums", F.lit(i))) for i in range(width)]
        found = blocks.select("trees").mapInArrow(_totals(books, leaf), "part bigint, entry bigint, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect()  # at most one row per entry of the codebooks
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def compress(rows: DataFrame, vector: str = "embedding", identity: str = "vec_id", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """`identity`, `code`, `error`, `label`, `label_error` and `codebooks_sha256` of every row that has a whole vector.

    A component x becomes floor(scale * x); vectors are cut into equal parts. The codebook of a part starts as that part
    of the `entries` smallest identities and is trained by Lloyd rounds: every part goes to its nearest entry (ties to the
    lower index), and an entry becomes the componentwise floor of the mean of its parts; unused entries stay. `code`
    holds two hex digits per part, `error` the squared distances, `label_error` their sum over rows of one label.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped. Null identities come last, equal
    ones in order of their vectors; repeated rows count as often as they occur. Null labels form one label. An empty
    table gives an empty result; other columns are ignored, whatever their names. Vectors of unequal lengths, lengths
    that the parts do not divide, and components of 2**27 or more after scaling are errors.

    Rows are packed into blocks where they lie, without an exchange, each with a tree per part whose boxes and sums are
    written once and serve all rounds. A vector that fills a third of the table shares nodes without extent, which are
    assigned whole.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of two hex digits hold 1 to 256 entries")
    kept = rows.select(F.col(f"`{identity}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v")).where(
        "v is not null and forall(v, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false))")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    if not first:
        empty = f"`{identity}` {kinds['id']}, code string, error bigint, `{label}` {kinds['label']}, label_error bigint, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    width = len(first[0]["v"])
    if width % parts or any(len(r["v"]) != width for r in first):
        raise ValueError(f"vectors must have equal lengths that {parts} divides")
    seeds = whole_numbers(np.array([r["v"] for r in first], np.float64).reshape(len(first), width), scale)
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    arrow = pa.schema([(n, _arrow_list(kept, n)) for n in ("id", "label")])
    blocks = cut_lineage(kept.mapInArrow(_grow_blocks(width, parts, scale, arrow, block, leaf),
                                         f"id array<{kinds['id']}>, label array<{kinds['label']}>, trees array<binary>"))
    books = train(blocks, books, rounds, leaf)
    listed = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = cut_lineage(blocks.mapInArrow(_codes(books, leaf, ["id", "label", "code", "error"]),
                                          f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")
                        .withColumn("key", key_of(F.col("label"))))
    totals = found.groupBy("key").agg(F.sum("error").alias("label_error"))
    return small_join(found, totals, ["key"], ["id", "code"]).select(
        F.col("id").alias(identity), "code", "error", F.col("label").alias(label), "label_error", F.lit(listed).alias("codebooks_sha256"))


def _arrow_list(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.list_(to_arrow_type(df.schema[name].dataType))
