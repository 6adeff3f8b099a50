"""A random forest grown level by level from histograms that Spark's tasks sum up.

Every level reads the written training rows once for all trees: a task walks its rows
down the trees so far and counts, per open node, candidate feature, bin and label, what
the tree drew of them; counts are added by tree, and each tree's splits are chosen where
its counts are.  How often a tree draws a row is a Poisson number by a hash of both, so
no weights are stored and a rerun draws the same.  The driver holds nodes, never rows.
Forests that each leave out a part of the rows grow together: a part is read, and its
draws made, once for all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Jobs carry the code of their tasks, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
# Rows that tell where bins begin; rows walked at once; open nodes counted in one pass.
SAMPLED, ROWS, OPEN_NODES = 20_000, 1 << 15, 50_000
# A place among the bins of a batch, below the next node.
PLACE = 32
SALT, LABEL = "_win_salt", "label"
COLUMNS = ("tree", "node", "place", "threshold", "left", "right", "gain", "n", "won")
SCHEMA = "tree int, node int, place int, threshold double, left int, right int, gain double, n double, won double"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, each tree's from 0 on; place is -1 in a leaf."""

    nodes: dict[str, np.ndarray]
    features: int

    @property
    def trees(self) -> int:
        return int(self.nodes["tree"].max()) + 1

    def importances(self) -> np.ndarray:
        """What splits gained by feature, as shares of each tree, over all trees."""
        inner = self.nodes["place"] >= 0
        gained = np.zeros((self.trees, self.features))
        np.add.at(gained, (self.nodes["tree"][inner], self.nodes["place"][inner]), (self.nodes["gain"] * self.nodes["n"])[inner])
        of_tree = gained.sum(1, keepdims=True)
        shares = np.divide(gained, of_tree, out=np.zeros_like(gained), where=of_tree > 0).sum(0)
        return shares / shares.sum() if shares.sum() else shares

    def save(self, spark: SparkSession, folder: str) -> None:
        leaf = self.nodes["place"] < 0
        lists = {c: self.nodes[c].tolist() for c in COLUMNS}
        for c in ("place", "threshold", "left", "right", "gain"):
            lists[c] = [None if is_leaf else v for v, is_leaf in zip(lists[c], leaf)]
        rows = list(zip(*(lists[c] for c in COLUMNS)))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)


def load_forest(spark: SparkSession, folder: str, features: int) -> Forest:
    """The nodes that :meth:`Forest.save` wrote; at most two to the depth for each tree."""
    rows = spark.read.parquet(folder).orderBy("tree", "node").collect()
    missing = {"place": -1, "threshold": 0.0, "left": 0, "right": 0, "gain": 0.0}
    kinds = {"threshold": float, "gain": float, "n": float, "won": float}
    filled = {c: [missing.get(c) if r[c] is None else r[c] for r in rows] for c in COLUMNS}
    return Forest({c: np.array(v, kinds.get(c, np.int64)) for c, v in filled.items()}, features)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed bits of ``x``, in its own memory."""
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=y)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=y)
    return x


def _draws() -> np.ndarray:
    """Poisson numbers of mean 1 at 65,536 even places of their distribution."""
    chance, sums = exp(-1), []
    for k in range(1, 12):
        sums.append(chance + (sums[-1] if sums else 0))
        chance /= k
    return np.searchsorted(sums, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _cuts(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 thresholds: half-way between distinct values, at even counts if there are many."""
    found, counts = np.unique(values[np.isfinite(values)], return_counts=True)
    halves = found[:-1] + (found[1:] - found[:-1]) / 2
    if len(halves) < BINS:
        return halves
    even = np.searchsorted(np.cumsum(counts), np.arange(1, BINS) * counts.sum() / BINS)
    return halves[np.unique(np.minimum(even, len(halves) - 1))]


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Spark's batches as batches of ROWS rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            whole = pa.concat_batches(held)
            for at in range(0, rows - ROWS + 1, ROWS):
                yield whole.slice(at, ROWS)
            held, rows = [whole.slice(rows - rows % ROWS)], rows % ROWS
    if rows:
        yield pa.concat_batches(held)


def _parted(batches, column: str | None) -> Iterator[tuple[object, pa.RecordBatch]]:
    """At most ROWS rows at a time that have one value of ``column``, and that value."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            if column is None:
                yield None, part
                continue
            of = part.column(column)
            for value in pc.unique(of).to_pylist():
                yield value, part.filter(pc.equal(of, value))


def _bins(part: pa.RecordBatch, names: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """The rows' bins: ROWS places for each feature, one after another."""
    bins = np.zeros((len(names), ROWS), np.uint8)
    for of_feature, f, c in zip(bins, names, cuts):
        of_feature[: part.num_rows] = np.searchsorted(c, part.column(f).to_numpy(zero_copy_only=False))
    return bins.reshape(-1)


def _tables(nodes: dict[str, np.ndarray], cuts: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """Per tree: place (0 in a leaf), last bin that goes left, first child, and won / n of its nodes.

    Right children follow left ones; a leaf sends every row to itself.
    """
    out = []
    starts = np.searchsorted(nodes["tree"], np.arange(nodes["tree"].max() + 2))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        place = nodes["place"][a:b]
        leaf = place < 0
        last = np.array([255 if p < 0 else np.searchsorted(cuts[p], x) for p, x in zip(place, nodes["threshold"][a:b])])
        child = np.where(leaf, np.arange(b - a), nodes["left"][a:b])
        chance = nodes["won"][a:b] / np.maximum(nodes["n"][a:b], 1)
        out.append((np.where(leaf, 0, place), last.astype(np.uint8), child.astype(np.int64), chance))
    return out


def _depth(table: tuple[np.ndarray, ...]) -> int:
    """Steps from the root to the lowest leaf."""
    steps, nodes = 0, np.zeros(1, np.int64)
    while len(nodes := nodes[table[1][nodes] < 255]):
        nodes = np.concatenate((table[2][nodes], table[2][nodes] + 1))
        steps += 1
    return steps


def _paths(table: tuple[np.ndarray, ...], shift: int) -> np.ndarray:
    """By node and bin of its feature (``shift`` bits): the next node, and below it where that one's bins begin."""
    place, last, child, _ = table
    after = child[:, None] + (np.arange(1 << shift) > last[:, None])
    return (after << (shift + PLACE) | (place * ROWS)[after]).reshape(-1)


def _shift(cuts: list[np.ndarray]) -> int:
    """Bits that hold any bin."""
    return max(map(len, cuts)).bit_length()


def _walked(table, paths: np.ndarray, bins: np.ndarray, rows: np.ndarray, steps: int, shift: int) -> np.ndarray:
    """The nodes that ``rows`` of a batch reach."""
    if not steps:
        return np.zeros(len(rows), np.int64)
    # Every place is inside; "wrap" only leaves out the test for it.
    at = paths.take(bins.take(rows + table[0][0] * ROWS, mode="wrap"), mode="wrap")
    for _ in range(steps - 1):
        here = bins.take((at & ((1 << PLACE) - 1)) + rows, mode="wrap")
        at = paths.take((at >> PLACE) + here, mode="wrap")
    return at >> (shift + PLACE)


def _counter(names, cuts, tables, level: int, open_nodes, seed: int, trees: int | None = None, without=(), column=None):
    """Counts by tree (candidates x open nodes x labels x bins) of the rows of a task.

    With ``trees``, there are so many of each forest, and ``cuts`` has those of one after another.
    """
    if trees is None:
        cuts, trees = [cuts], max(open_nodes) + 1
    draws = _draws()
    of_forest = [[t for t in open_nodes if t // trees == f] for f in range(len(cuts))]

    def drawn(salt: np.ndarray, tree: int) -> np.ndarray:
        mixed = _mix(salt ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + (seed << 20))) & 0xFFFFFFFFFFFFFFFF))
        mixed >>= np.uint64(48)
        return draws.take(mixed.view(np.int64), mode="wrap")

    def run(batches) -> Iterator[pa.RecordBatch]:
        # A candidate's counts of a tree lie together, so that adding a batch visits little memory.
        sums = {t: np.zeros((tried.shape[1], len(tried) * 2 * BINS)) for t, (_, tried) in open_nodes.items()}
        paths = {t: _paths(tables[t], _shift(cuts[t // trees])) for t in open_nodes}
        starts = {t: [np.ascontiguousarray(c) for c in (tried * ROWS).T] for t, (_, tried) in open_nodes.items()}
        for value, part in _parted(_merged(batches), column):
            salt = part.column(SALT).to_numpy().view(np.uint64)
            won = (part.column(LABEL).to_numpy(zero_copy_only=False) == 1) * BINS
            # Forests draw alike, so that what one tree draws is found once for all of them.
            taken = {t: drawn(salt, t) for t in {t % trees for t in open_nodes}}
            for f, here_trees in enumerate(of_forest):
                if not here_trees or (column is not None and without[f] == value):
                    continue
                bins, shift = _bins(part, names, cuts[f]), _shift(cuts[f])
                for tree in here_trees:
                    slots = open_nodes[tree][0]
                    rows = np.flatnonzero(taken[tree % trees] > 0)
                    slot = slots.take(_walked(tables[tree], paths[tree], bins, rows, level, shift), mode="wrap")
                    here = slot >= 0
                    if not here.all():
                        rows, slot = rows[here], slot[here]
                    weight = taken[tree % trees].take(rows, mode="wrap").astype(np.float64)
                    first = slot * (2 * BINS) + won.take(rows, mode="wrap")
                    for of_candidate, start in zip(sums[tree], starts[tree]):
                        key = first + bins.take(start.take(slot, mode="wrap") + rows, mode="wrap")
                        of_candidate += np.bincount(key, weight, len(of_candidate))
        for tree, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([counts.tobytes()])], ["tree", "counts"])

    return run


def _packed(counter):
    """Its counts, all whole numbers, in the fewest bytes each that hold them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in counter(batches):
            counts = np.frombuffer(batch.column("counts")[0].as_buffer(), np.float64)
            counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array([counts.tobytes()])], ["tree", "counts"])

    return run


def _splitter(open_nodes, cuts, trees: int, min_leaf: int):
    """The best split of each open node, from the counts of one tree."""

    def impurity(n, won):
        share = won / np.maximum(n, 1)
        return 2 * share * (1 - share)

    def run(key, table):
        tree = key[0].as_py()
        slots, tried = open_nodes[tree]
        counts = np.zeros(tried.size * 2 * BINS)
        for x in table.column("counts"):
            packed = x.as_buffer()
            counts += np.frombuffer(packed, f"u{packed.size // counts.size}")
        counts = counts.reshape(tried.shape[1], len(tried), 2, BINS).swapaxes(0, 1)
        n, won = counts.sum(2), counts[:, :, 1]
        n_left, won_left = n.cumsum(2)[:, :, :-1], won.cumsum(2)[:, :, :-1]
        n_all, won_all = n[:, 0].sum(1), won[:, 0].sum(1)
        total_n, total_won = n_all[:, None, None], won_all[:, None, None]
        n_right, won_right = total_n - n_left, total_won - won_left
        parts = n_left * impurity(n_left, won_left) + n_right * impurity(n_right, won_right)
        gain = impurity(total_n, total_won) - parts / np.maximum(total_n, 1)
        possible = np.array([len(c) for c in cuts[tree // trees]])[tried][:, :, None] > np.arange(BINS - 1)
        gain = np.where(possible & (n_left >= min_leaf) & (n_right >= min_leaf), gain, 0.0).reshape(len(tried), -1)
        best = gain.argmax(1)
        i = np.arange(len(tried))
        k, cut = best // (BINS - 1), best % (BINS - 1)
        at = (i, k, cut)
        columns = [np.full(len(i), tree), np.argsort(slots)[-len(i) :], tried[i, k], cut, gain[i, best], n_all, won_all, n_left[at], won_left[at]]
        return pa.table([pa.array(c) for c in columns], ["tree", "node", "place", "cut", "gain", "n", "won", "n_left", "won_left"])

    return run


_SPLITS = "tree long, node long, place long, cut long, gain double, n double, won double, n_left double, won_left double"


@lru_cache(1 << 18)
def _candidates(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """The features that a node tries: the square root of all."""
    return np.sort(np.random.default_rng((seed, tree, node)).permutation(features)[: ceil(sqrt(features))])


def fit_forest(rows: DataFrame, names: list[str], trees: int, depth: int, min_leaf: int, seed: int) -> Forest:
    """A forest on written ``rows`` (label, SALT and the columns ``names``, all numbers without null).

    Each node tries the square root of the features; its split has the largest decrease of
    the Gini impurity and ``min_leaf`` drawn rows on both sides.
    """
    return fit_forests(rows, names, trees, depth, min_leaf, seed, [None], None)[0]


def fit_forests(
    rows: DataFrame, names: list[str], trees: int, depth: int, min_leaf: int, seed: int, without: list, column: str | None
) -> list[Forest]:
    """A forest for each value in ``without``, each as :func:`fit_forest` grows it on the rows with another one in ``column``.

    They grow level by level together.  A task reads its rows fastest if those with one value lie together.
    """
    cuts = []
    for value in without:
        of = rows if column is None else rows.where(F.col(column) != value)
        size = of.count()
        if not size:
            raise ValueError("no closed deals to fit on")
        some = of.where(F.pmod(F.xxhash64(SALT, F.lit(seed)), F.lit(max(1, size // SAMPLED))) == 0)
        sample = np.array([tuple(r) for r in some.select(*names).collect()] or np.zeros((0, len(names))), np.float64)
        cuts.append([_cuts(sample[:, i]) for i in range(len(names))])
    # The trees of the first forest, then those of the next.
    count = trees * len(without)
    grown = [{"place": [-1], "threshold": [0.0], "left": [0], "right": [0], "gain": [0.0], "n": [0.0], "won": [0.0]} for _ in range(count)]
    opened = {t: [0] for t in range(count)}
    for level in range(depth):
        tables = [x for f, c in enumerate(cuts) for x in _tables(_flat(grown[f * trees : (f + 1) * trees]), c)]
        following: dict[int, list[int]] = {}
        # Trees that draw alike are counted in one pass.
        waiting = sorted((t for t in range(count) if opened.get(t)), key=lambda t: (t % trees, t))
        while waiting:
            group, nodes = {}, 0
            while waiting and (not group or nodes + len(opened[waiting[0]]) <= OPEN_NODES):
                t = waiting.pop(0)
                nodes += len(opened[t])
                slots = np.full(len(grown[t]["place"]), -1)
                slots[opened[t]] = np.arange(len(opened[t]))
                tried = [_candidates(seed, t % trees, x, len(names)) for x in opened[t]]
                group[t] = slots, np.array(tried)
            of_group = {t: tables[t] for t in group}
            counter = _counter(names, cuts, of_group, level, group, seed, trees, without, column)
            counted = rows.mapInArrow(_packed(counter), "tree int, counts binary")
            splits = counted.groupBy("tree").applyInArrow(_splitter(group, cuts, trees, min_leaf), _SPLITS)
            # A row for each open node.
            for t, node, place, cut, gain, n, won, n_left, won_left in sorted(map(tuple, splits.collect())):
                tree = grown[t]
                tree["n"][node], tree["won"][node] = n, won
                if gain <= 1e-12:
                    continue
                left = len(tree["place"])
                values = {"place": place, "threshold": float(cuts[t // trees][place][cut]), "left": left, "right": left + 1, "gain": gain}
                for c, v in values.items():
                    tree[c][node] = v
                for x, (n_x, won_x) in enumerate(((n_left, won_left), (n - n_left, won - won_left))):
                    for c, v in {"place": -1, "threshold": 0.0, "left": 0, "right": 0, "gain": 0.0, "n": n_x, "won": won_x}.items():
                        tree[c].append(v)
                    if 0 < won_x < n_x and n_x >= 2 * min_leaf:
                        following.setdefault(t, []).append(left + x)
        opened = following
    return [Forest(_flat(grown[at : at + trees]), len(names)) for at in range(0, count, trees)]


def _flat(grown: list[dict[str, list]]) -> dict[str, np.ndarray]:
    sizes = [len(t["place"]) for t in grown]
    kinds = {"place": np.int64, "left": np.int64, "right": np.int64}
    joined = {c: np.array([v for t in grown for v in t[c]], kinds.get(c, np.float64)) for c in grown[0]}
    return {"tree": np.repeat(np.arange(len(grown)), sizes), "node": np.concatenate([np.arange(n) for n in sizes]), **joined}


def with_chance(forest: Forest, rows: DataFrame, names: list[str], column: str) -> DataFrame:
    """``rows`` with the mean of their leaves' shares of won deals."""
    place, threshold = forest.nodes["place"], forest.nodes["threshold"]
    cuts = [np.unique(threshold[place == i]) for i in range(len(names))]
    tables, trees, shift = _tables(forest.nodes, cuts), forest.trees, _shift(cuts)
    steps = max(map(_depth, tables))

    def run(batches) -> Iterator[pa.RecordBatch]:
        paths = [_paths(table, shift) for table in tables]
        for _, part in _parted(batches, None):
            bins = _bins(part, names, cuts)
            at, sums = np.arange(part.num_rows), np.zeros(part.num_rows)
            for table, of_tree in zip(tables, paths):
                sums += table[3].take(_walked(table, of_tree, bins, at, steps, shift))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums / trees)], [*part.schema.names, column])

    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())])
    return rows.mapInArrow(run, schema)
