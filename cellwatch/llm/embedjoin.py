"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated to the principal axes of a bounded sample and split into
blocks of axes.  A pair with cosine ``c`` or more has a squared distance of at most
``2 - 2 c``.  That budget is dealt to the blocks in proportion to their variance, so each
such pair is within its budget in at least one block.  In each block a range join
finds those pairs: a grid over the block's first axes, with cells as wide as the search
ball, brings each vector to its home cell and to the cells that its ball reaches.
Pairs found are verified with the cosine of the original vectors in double precision.

Each vector is stored once, in a tile of ``HOME_ROWS`` at most: a tree of medians of the sample
halves the rotated space into leaves, and crowded leaves are cut.  A task takes pairs of tiles whose
boxes are within budget in some block and does all blocks of both, so vectors go to no cell by
themselves: pairs of tiles are made where they are read, and disk grows with the vectors only.
A pair of vectors counts in the first block that finds it, and no list
of pairs is made: a task adds its pairs, ``PAIRS`` at a time, to each vector's number of links
and to a spanning forest, returns these, and components come from the forests.  Equal vectors are one, with a
weight.  The number of cells is bounded by geometry: axes of unit vectors run from -1 to 1.

Defined results: vectors that are null, zero, or hold a null or a number that isn't finite
have no links and themselves as component; a shorter vector counts as if zeros followed;
equal rows link with each other, repeated ids too; the smallest id passes over nulls, and
a null id is kept if its component is null; other columns play no part.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from cellwatch.llm.components import components
from cellwatch.llm.shared import giving_back, stored
from cellwatch.llm.vectors import matrix, rows_of, usable, width

COSINE = 0.9
#: The most axes of a block, and how many of them the grid has.
BLOCK_AXES = 8
GRID_AXES = 2
#: Vectors that the rotation and the tree are fitted to, at most, and how many of them a leaf has at least.
FIT_ROWS = 20_000
LEAF_SAMPLE = 16
#: Vectors of a tile, and vectors that those at home are compared with at a time.
HOME_ROWS, OTHER_ROWS = 8_000, 32_000
#: What rounding to single precision may add to a block's squared distance.
SLACK = 1e-6
#: Vectors that are compared with others at a time, and pairs that are verified at a time.
TOGETHER = 256
PAIRS = 1 << 17


@dataclass
class Blocks:
    """The rotation, each block's axes (the most varied first), budgets and the grid's cell widths."""

    rotation: np.ndarray
    axes: list[np.ndarray]
    budgets: np.ndarray

    @property
    def reach(self) -> np.ndarray:
        return np.sqrt(self.budgets + SLACK) + SLACK

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated unit vectors in single precision: every task works on the same rounded values."""
        return ((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation).astype(np.float32)

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and the first and last cells reached, per grid axis."""
        at, reach = rotated[:, self.axes[block][:GRID_AXES]].astype(np.float64), self.reach[block]
        cell = 2.0 * reach
        return tuple(np.floor(x / cell).astype(np.int64) for x in (at, at - reach, at + reach))


def fit_blocks(sample: np.ndarray, dimensions: int, cosine: float) -> Blocks:
    count = max(1, -(-dimensions // BLOCK_AXES))
    if len(sample):
        units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        variance, rotation = np.linalg.eigh(np.cov(units, rowvar=False).reshape(dimensions, dimensions) if len(units) > 1 else np.eye(dimensions))
        variance, rotation = np.maximum(variance[::-1], 0.0), rotation[:, ::-1]
    else:
        variance, rotation = np.ones(dimensions), np.eye(dimensions)
    # Dealt to and fro, so that blocks have about the same variance.
    order = np.arange(dimensions)
    turn = order % (2 * count)
    block = np.where(turn < count, turn, 2 * count - 1 - turn)
    axes = [order[block == b] for b in range(count)]
    shares = np.array([variance[a].sum() for a in axes]) + 1e-9
    return Blocks(rotation, axes, (2.0 - 2.0 * cosine) * shares / shares.sum())


def _number_type(vectors: DataFrame) -> type:
    """What holds the vectors' numbers exactly."""
    return np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64


@dataclass
class Tree:
    """Halvings of the rotated space, level by level: the children of node ``i`` are ``2 i + 1`` and ``2 i + 2``."""

    axes: np.ndarray
    bounds: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.axes).bit_length()

    def leaves(self, rotated: np.ndarray) -> np.ndarray:
        """The leaf of each vector, from 0."""
        node, row = np.zeros(len(rotated), np.int64), np.arange(len(rotated))
        for _ in range(self.depth):
            node = 2 * node + 1 + (rotated[row, self.axes[node]] > self.bounds[node])
        return node - len(self.axes)


def fit_tree(rotated: np.ndarray, rows: int) -> Tree:
    """Medians of a sample of ``rows`` vectors, along the axis that varies most, down to leaves of ``HOME_ROWS``."""
    depth = max(0, min((-(-rows // HOME_ROWS) - 1).bit_length(), (len(rotated) // LEAF_SAMPLE).bit_length() - 1))
    axes, bounds, parts = [], [], [rotated]
    for _ in range(depth):
        halves = []
        for part in parts:
            axis = int(part.var(axis=0).argmax()) if len(part) else 0
            bound = float(np.median(part[:, axis])) if len(part) else 0.0
            above = part[:, axis] > bound
            axes.append(axis)
            bounds.append(bound)
            halves += [part[~above], part[above]]
        parts = halves
    return Tree(np.array(axes, np.int64), np.array(bounds))


def _placed(classes: DataFrame, blocks: Blocks, dimensions: int, tree: Tree, tiles: dict[int, tuple[int, int]] | None) -> DataFrame:
    """Each class's leaf, or with a leaf's first tile and number of tiles given, its tile and data."""
    slim, exact = tiles is None, _number_type(classes)
    schema = "leaf int" if slim else "tile int, id long, copies long, vector binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            vectors = matrix(batch.column("embedding"), dimensions)
            leaf = tree.leaves(blocks.rotated(vectors))
            if slim:
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32())], ["leaf"])
                continue
            first, count = np.array([tiles[x] for x in leaf.tolist()]).T
            ids = batch.column("id").to_numpy()
            raw = pa.array([v.tobytes() for v in vectors.astype(exact)], pa.binary())
            columns = [pa.array(first + ids % count, pa.int32()), batch.column("id"), batch.column("copies"), raw]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "id", "copies", "vector"])

    return classes.select("id", "copies", "embedding").mapInArrow(work, schema)


def _tiles(placed: DataFrame, count: int, blocks: Blocks, dimensions: int, exact: type) -> DataFrame:
    """A row per tile: its vectors in order of ``id``, and the box that they take in each block."""
    schema = "tile int, ids binary, copies binary, vectors binary, low array<array<double>>, high array<array<double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.to_pandas() for b in batches if b.num_rows]
        for tile, part in pd.concat(rows).groupby("tile") if rows else ():
            part = part.sort_values("id")
            rotated = blocks.rotated(rows_of(part, "vector", exact, dimensions)).astype(np.float64)
            with warnings.catch_warnings():  # vectors whose squares vanish have no place
                warnings.simplefilter("ignore", RuntimeWarning)
                low, high = np.nanmin(rotated, axis=0), np.nanmax(rotated, axis=0)
            yield pa.RecordBatch.from_pylist([{
                "tile": tile, "ids": part["id"].to_numpy(np.int64).tobytes(), "copies": part["copies"].to_numpy(np.int64).tobytes(),
                "vectors": b"".join(part["vector"]), "low": [low[a].tolist() for a in blocks.axes], "high": [high[a].tolist() for a in blocks.axes],
            }], pa.schema([("tile", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()),
                           ("low", pa.list_(pa.list_(pa.float64()))), ("high", pa.list_(pa.list_(pa.float64())))]))

    return placed.repartitionById(max(1, count), F.col("tile")).mapInArrow(giving_back(work), schema)


def _within_reach(blocks: Blocks) -> Column:
    """Whether some vectors of the boxes ``low`` to ``high`` and ``other_low`` to ``other_high`` may be within budget in a block."""
    budgets = F.array(*[F.lit(float(x) + 4 * SLACK) for x in blocks.budgets])

    def near(block: Column) -> Column:
        low, high, other_low, other_high = (F.get(F.col(c), block) for c in ("low", "high", "other_low", "other_high"))
        below, above = F.zip_with(low, other_high, lambda x, y: x - y), F.zip_with(other_low, high, lambda x, y: x - y)
        squares = F.zip_with(below, above, lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), F.lit(2.0)))
        return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) <= F.get(budgets, block)

    return F.exists(F.sequence(F.lit(0), F.lit(len(blocks.axes) - 1)), near)


def _forest(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest position linked to each position."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper
        if (root == before).all():
            return root


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``root``, the smallest position linked to each position, with more links taken in."""
    left, right = root[left], root[right]
    apart = left != right
    if not apart.any():
        return root
    left, right = left[apart], right[apart]
    used = np.union1d(left, right)
    whole = np.arange(len(root))
    whole[used] = used[_forest(np.searchsorted(used, left), np.searchsorted(used, right), len(used))]
    return whole[root]


class _Vectors:
    """Vectors that a task has at hand; ``at`` are their places among those that it counts."""

    def __init__(self, blocks: Blocks, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, at: np.ndarray):
        self.ids, self.copies, self.vectors, self.rotated, self.at = ids, copies, vectors, rotated, at
        self.norms = np.linalg.norm(vectors, axis=1)


class _Links:
    """Numbers of links and a spanning forest of the vectors that a task has met."""

    def __init__(self, count: int = 0):
        self.links, self.met, self.root = np.zeros(count, np.int64), np.zeros(count, bool), np.arange(count)

    def more(self, count: int) -> np.ndarray:
        """Places of so many more vectors."""
        places = np.arange(len(self.root), len(self.root) + count)
        self.links, self.met = np.append(self.links, np.zeros(count, np.int64)), np.append(self.met, np.zeros(count, bool))
        self.root = np.append(self.root, places)
        return places

    def add(self, rows: _Vectors, x: np.ndarray, y: np.ndarray, both: bool) -> None:
        """Take in the pairs of ``x`` and ``y``; links are counted at ``x``, or at both ends."""
        if not len(x):
            return
        left, right = rows.at[x], rows.at[y]
        np.add.at(self.links, left, rows.copies[y])
        if both:
            np.add.at(self.links, right, rows.copies[x])
        self.met[left] = self.met[right] = True
        self.root = _joined(self.root, left, right)


def _meet(blocks: Blocks, cosine: float, block: int, rows: _Vectors, homes: np.ndarray, others: np.ndarray, both: bool, out: _Links) -> None:
    """Links of a cell's vectors at home with those whose balls reach it, as far as ``block`` is the first to find them."""
    axes = blocks.axes[block]
    # One product of these gives squared distances, in single precision: a first sieve with more slack.
    near, far = rows.rotated[homes][:, axes], rows.rotated[others][:, axes]
    # Beyond the grid's axes, one more axis in order: a few vectors at a time meet those within reach only.
    third = min(GRID_AXES, len(axes) - 1)
    order, other_order = np.argsort(near[:, third]), np.argsort(far[:, third])
    homes, near, others, far = homes[order], near[order], others[other_order], far[other_order]
    one, other_one = np.ones((len(homes), 1)), np.ones((len(others), 1))
    here = np.concatenate([-2.0 * near, (near ** 2).sum(axis=1)[:, None], one], axis=1).astype(np.float32)
    there = np.concatenate([far, other_one, (far ** 2).sum(axis=1)[:, None]], axis=1).astype(np.float32)
    reach, along, ordered = blocks.reach[block], near[:, third], far[:, third]
    # Pairs go into these, a block of them at a time, and are dropped.
    for start in range(0, len(homes), TOGETHER):
        stop = min(start + TOGETHER, len(homes))
        low, high = np.searchsorted(ordered, [along[start] - reach, along[stop - 1] + reach])
        for first in range(low, high, OTHER_ROWS):
            last = min(first + OTHER_ROWS, high)
            close = here[start:stop] @ there[first:last].T <= np.float32(blocks.budgets[block] + 4 * SLACK)
            found = np.flatnonzero(close)
            for at in range(0, len(found), PAIRS):
                x, y = np.divmod(found[at:at + PAIRS], last - first)
                x, y = homes[start + x], others[first + y]
                good = rows.ids[x] != rows.ids[y]
                x, y = x[good], y[good]
                good = np.einsum("ij,ij->i", rows.vectors[x], rows.vectors[y]) >= cosine * rows.norms[x] * rows.norms[y]
                x, y = x[good], y[good]
                # The first block that finds the pair counts it.
                squares = (rows.rotated[x] - rows.rotated[y]) ** 2
                within = np.stack([squares[:, blocks.axes[k]].sum(axis=1) <= blocks.budgets[k] + SLACK for k in range(block + 1)], axis=1)
                good = within[:, block] & ~within[:, :block].any(axis=1)
                out.add(rows, x[good], y[good], both)


def _cell_links(blocks: Blocks, dimensions: int, cosine: float, exact: type):
    """Links within one cell of one block, given as a frame."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        ids, rotated = rows["id"].to_numpy(), rows_of(rows, "rotated", np.float32, dimensions)
        here = _Vectors(blocks, ids, rows["copies"].to_numpy(), rows_of(rows, "vector", exact, dimensions), rotated, np.arange(len(rows)))
        out = _Links(len(rows))
        _meet(blocks, cosine, int(rows["block"].iloc[0]), here, np.flatnonzero(rows["home"].to_numpy()), np.arange(len(rows)), False, out)
        return _returned(ids, out)

    return work


def _returned(ids: np.ndarray, out: _Links) -> pd.DataFrame:
    used = np.flatnonzero(out.met)
    return pd.DataFrame({"id": ids[used], "links": out.links[used], "root": ids[out.root[used]]})


def _tile_links(pairs: DataFrame, blocks: Blocks, dimensions: int, cosine: float, exact: type) -> DataFrame:
    """``id, links, root`` of the vectors that have links in a task's pairs of tiles, all blocks one after the other."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ids, out = {}, [], _Links()

        def opened(tile: int, *raw: bytes) -> tuple[np.ndarray, ...]:
            own, copies = (np.frombuffer(x, np.int64) for x in raw[:2])
            vectors = np.frombuffer(raw[2], exact).reshape(len(own), dimensions).astype(np.float64)
            if tile not in places:
                places[tile] = out.more(len(own))
                ids.append(own.copy())
            return own, copies, vectors, blocks.rotated(vectors).astype(np.float64), places[tile]

        for batch in batches:
            for i in range(batch.num_rows):
                left, right = ([c[i].as_py() for c in batch.columns[at:at + 4]] for at in (0, 4))
                both, first = left[0] != right[0], opened(*left)
                parts = [first, opened(*right)] if both else [first]
                rows = _Vectors(blocks, *[np.concatenate(x) for x in zip(*parts)])
                homes = np.arange(len(first[0]))
                others = np.arange(len(homes), len(rows.ids)) if both else homes
                for block in range(len(blocks.axes)):
                    _block_links(blocks, cosine, block, rows, homes, others, both, out)
        if ids:
            yield pa.RecordBatch.from_pandas(_returned(np.concatenate(ids), out), preserve_index=False)

    return pairs.mapInArrow(giving_back(work), "id long, links long, root long")


def _block_links(blocks: Blocks, cosine: float, block: int, rows: _Vectors, homes: np.ndarray, others: np.ndarray, both: bool, out: _Links) -> None:
    """The grid of a block: vectors at home in a cell meet those whose balls reach the cell."""
    home, low, high = blocks.cells(rows.rotated, block)
    for cell in np.unique(home[homes], axis=0):
        reached = ((low[others] <= cell) & (cell <= high[others])).all(axis=1)
        if reached.any():
            _meet(blocks, cosine, block, rows, homes[(home[homes] == cell).all(axis=1)], others[reached], both, out)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``embeddings`` (``vec_id``, ``embedding``)."""
    rows = embeddings.select("vec_id", F.when(usable(), F.col("embedding")).alias("embedding"))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    dimensions = width(classes)
    sample = classes.orderBy(F.xxhash64("embedding")).limit(FIT_ROWS).select("embedding").toArrow()
    fitted = matrix(sample.column("embedding").combine_chunks(), dimensions) if sample.num_rows else np.zeros((0, dimensions))
    blocks = fit_blocks(fitted, dimensions, cosine)
    exact, tree = _number_type(classes), fit_tree(blocks.rotated(fitted) if len(fitted) else fitted, classes.count())
    counted = _placed(classes, blocks, dimensions, tree, None).groupBy("leaf").count()
    tiles, count = {}, 0
    for leaf, size in sorted(map(tuple, counted.collect())):
        tiles[leaf] = (count, -(-size // HOME_ROWS))
        count += tiles[leaf][1]
    held = stored(_tiles(_placed(classes, blocks, dimensions, tree, tiles), count, blocks, dimensions, exact), "vector-tiles")
    names = ["tile", "ids", "copies", "vectors"]
    other = held.select(*[F.col(c).alias(f"other_{c}") for c in held.columns])
    # Pairs of tiles come from reading both sides again, without an exchange.
    pairs = held.join(other.hint("shuffle_replicate_nl"), (F.col("tile") <= F.col("other_tile")) & _within_reach(blocks))
    found = stored(_tile_links(pairs.select(*names, *[f"other_{c}" for c in names]), blocks, dimensions, cosine, exact), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    # Vectors themselves go through one join only.
    known = classes.select("id", "first", "copies").join(links, "id", "left").join(whole.select(F.col("node").alias("id"), "component"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    smallest = known.groupBy("component").agg(F.min("first").alias("smallest"))
    known = known.join(smallest, "component").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "smallest")
    joined = rows.join(classes.select("embedding", "id"), "embedding", "left").select("vec_id", "id").join(known, "id", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
