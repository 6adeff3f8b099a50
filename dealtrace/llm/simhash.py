"""SimHash fingerprints, and links between near ones by a grid on segment bit counts.

A fingerprint is cut into segments and mapped to the bit count of each.  The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints, so a range join on a grid over the vectors finds every near pair.
The segments form blocks; two fingerprints within ``d`` bits have a block in
which the vectors are within ``d // blocks``, so a block's cell and the cells
that near are enough.  What meets in a cell is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from .common import forget, keep, pieces, texts
from .components import components

SEED = 42
SEGMENT_BITS = 2
# Least and largest number of rows in a tile, rows of it in the sample, and pivots of a larger cell.
LEAST_TILE, LARGEST_TILE, SAMPLED, PIVOTS = 256, 16384, 64, 4
# Pairs of fingerprints compared at once.
PAIRS = 1 << 21

# A-Z to lower case, white space to one space, the rest unchanged.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_EVEN = np.uint64(0x5555555555555555)
_LOW = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Grid:
    """How fingerprints of ``words`` 64-bit numbers are linked.

    ``blocks`` blocks of ``block_bits`` bits; in one of them the vectors must be
    within ``radius`` (0 or 1).  Links are pairs within ``max_bits`` of the
    first ``verify_words`` numbers.  No pair is missed if
    ``max_bits < blocks * (radius + 1)`` and the blocks cover those numbers.
    With ``marks`` so many numbers of parity marks and the set's size come after
    those, and pairs must be :func:`_close` by them too.
    """

    words: int = 1
    blocks: int = 2
    block_bits: int = 32
    radius: int = 1
    max_bits: int = 3
    verify_words: int = 1
    marks: int = 0

    @property
    def carried(self) -> int:
        """Numbers that a row in a cell carries."""
        return self.verify_words + (self.marks + 1 if self.marks else 0)


EXACT = Grid()
# For sets with a similarity of 0.8 or more, which meet in the cells of their prefixes. Two such
# sets differ in up to a fifth of the bits, 51 of 256 with a deviation of 6.4, so that the
# bound, seven deviations away, only drops pairs that are not similar. Their parity marks differ in no more
# places than the sets do, so that bound drops no similar pair at all.
MARKS = 8
SIMILAR = Grid(words=4 + MARKS + 1, blocks=0, radius=0, max_bits=96, verify_words=4, marks=MARKS)
# Shingles that a piece of texts has so often are counted; so many of the commonest come last in prefixes.
OFTEN, COMMON = 8, 1 << 16
# Positions, and 64-bit numbers, of the bitmap of wanted texts.
BITMAP_WORDS = 1 << 18


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def _mix(x: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits from a hash; the first word is the hash itself."""
    if not word:
        return x
    x = x + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    out = np.zeros(words, np.uint64)
    if not len(hashes):
        return out
    for k in range(words):
        count = np.zeros((8, 8), np.int64)
        for at in range(0, len(hashes), 255 << 8):
            part = _mix(hashes[at : at + (255 << 8)], k)
            # One bit of each of the eight bytes at a time; 255 of them do not run over.
            starts = np.arange(0, len(part), 255)
            for bit in range(8):
                sums = np.add.reduceat((part >> np.uint64(bit)) & _LOW, starts)
                count[:, bit] += sums.view(np.uint8).reshape(-1, 8).sum(0, np.int64)
        out[k] = np.packbits(2 * count.reshape(-1) > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(
    docs: DataFrame, width: int = 3, words: int = 1, names: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``names`` and fp per row of ``docs`` (names, text); fp has ``words`` numbers.

    Words are runs other than ASCII white space, A-Z in lower case.  A null or
    empty text has fingerprint zero; nulls in the named columns stay; other
    columns are not looked at.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [fingerprint(shingle_hashes(raw, width), words) for raw in texts(batch.column("text"))]
            flat = pa.array(np.concatenate(found).view(np.int64))
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.ListArray.from_arrays(offsets, flat)], [*names, "fp"]
            )

    plain = docs.select(*names, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} {k}" for c, k in plain.dtypes if c != "text")
    return plain.mapInArrow(run, f"{kinds}, fp array<bigint>")


def _block(words: np.ndarray, grid: Grid, block: int) -> np.ndarray:
    """Bits of one block of fingerprints (rows x words), from bit 0 on."""
    bit = block * grid.block_bits
    word, shift = divmod(bit, 64)
    x = words[:, word] >> np.uint64(shift)
    if shift + grid.block_bits > 64:
        x = x | (words[:, word + 1] << np.uint64(64 - shift))
    return x & np.uint64((1 << grid.block_bits) - 1)


def _counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its own two bits."""
    return (x & _EVEN) + ((x >> np.uint64(1)) & _EVEN)


def _cells(fps: np.ndarray, grid: Grid, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, cells, own) for the own cells of all rows in the first ``blocks`` blocks, and those one step up.

    Of two vectors one step apart one is a step up from the other, so looking
    upwards finds every such pair once.
    """
    rows = np.arange(len(fps))
    for block in range(blocks):
        own = _counts(_block(fps, grid, block))
        yield block, rows, own, True
        if grid.radius:
            for segment in range(grid.block_bits // SEGMENT_BITS):
                shift = np.uint64(SEGMENT_BITS * segment)
                up = (own >> shift) & np.uint64(3) < SEGMENT_BITS
                yield block, rows[up], own[up] + (np.uint64(1) << shift), False


def _keyed(batch: pa.RecordBatch, grid: Grid, blocks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, own, row, bits, node, label) of some rows at a time; a cell's number and its block's are one key.

    Rows with a column ``prefix`` have the cells listed there.
    """
    for at in range(0, batch.num_rows, 4096):
        part = batch.slice(at, 4096)
        fps = part.column("fp").flatten().to_numpy().reshape(-1, grid.words).view(np.uint64)
        node, label = part.column("node").to_numpy(), part.column("label").to_numpy()
        if "prefix" in part.schema.names:
            cells = part.column("prefix")
            key = cells.flatten().to_numpy()
            rows = np.repeat(np.arange(len(fps)), np.diff(cells.offsets.to_numpy()))
            yield key, np.ones(len(key), bool), rows, fps[:, : grid.carried], node, label
            continue
        for block, rows, cells, own in _cells(fps, grid, blocks):
            if len(rows):
                key = (cells * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(block)
                yield key.view(np.int64), np.full(len(rows), own), rows, fps[:, : grid.carried], node, label


def _schema(grid: Grid) -> str:
    return "cell bigint, kind tinyint, node bigint, label bigint, " + ", ".join(
        f"f{k} bigint" for k in range(grid.carried)
    )


def _dealt_rows(cell, own, side, rows, bits, node, label) -> pa.RecordBatch:
    columns = {"cell": cell, "kind": (2 * side + ~own).astype(np.int8), "node": node[rows], "label": label[rows]}
    columns |= {f"f{k}": np.ascontiguousarray(bits[rows, k]).view(np.int64) for k in range(bits.shape[1])}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _to_tiles(grid: Grid, blocks: int, dense: dict[int, tuple[int, int, int]]):
    """Rows of every cell; those of the cells in ``dense`` cut into tiles.

    ``dense``: per cell, its commonest label, and into how many parts the rows
    with that label and the others are cut.  Each part of the others meets every
    part; rows with the commonest label do not meet one another, they are linked.
    """
    cells = np.array(sorted(dense), np.int64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, rows, bits, node, label in _keyed(batch, grid, blocks):
                cut = np.isin(key, cells)
                if not cut.all():
                    some = ~cut
                    yield _dealt_rows(key[some], own[some], np.zeros(some.sum(), np.int8), rows[some], bits, node, label)
                for cell in np.unique(key[cut]).tolist():
                    common, linked, others = dense[cell]
                    here = np.flatnonzero(key == cell)
                    salt = _mix(node[rows[here]].view(np.uint64), 7)
                    home = (label[rows[here]] == common) & (linked > 0)
                    tiles = [(home, i, others + salt % np.uint64(linked or 1)) for i in range(others)]
                    mine = (salt % np.uint64(others)).astype(np.int64)
                    tiles += [(~home, mine, other) for other in range(others + linked)]
                    for who, one, two in tiles:
                        if not who.any():
                            continue
                        one, two = (np.broadcast_to(np.asarray(x, np.int64), who.shape)[who] for x in (one, two))
                        first, last = np.minimum(one, two), np.maximum(one, two)
                        # 0: meets all rows of the tile; 1 and 2: meet only each other.
                        side = np.where(first == last, 0, np.where(home[who] | (one > two), 2, 1)).astype(np.int8)
                        tile = _mix(np.uint64(cell & 0xFFFFFFFFFFFFFFFF) ^ _mix((first << 32 | last).view(np.uint64), 5), 3)
                        at = here[who]
                        yield _dealt_rows(tile.view(np.int64), own[at], side, rows[at], bits, node, label)

    return run


def _sample(nodes: DataFrame, grid: Grid, blocks: int, every: int) -> DataFrame:
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(every)) == 0)
    return some.mapInArrow(_to_tiles(grid, blocks, {}), _schema(grid))


def _pivots(sample: DataFrame, grid: Grid, least: int) -> dict[int, np.ndarray]:
    """(node, bits) of a few rows of every cell with over ``least`` rows in the sample, the same ones for like cells."""
    one = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", *(f"f{i}" for i in range(grid.carried))))
    counted = sample.groupBy("cell").agg(F.count("*").alias("n"), *(one(k + 2).alias(f"p{k}") for k in range(PIVOTS)))
    rows = counted.where(F.col("n") > least).collect()
    return {r.cell: np.array([list(r[f"p{k}"])[1:] for k in range(PIVOTS)], np.int64) for r in rows}


def _to_pivots(grid: Grid, blocks: int, pivots: dict[int, np.ndarray]):
    cells = np.array(sorted(pivots), np.int64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for key, _, rows, bits, node, _ in _keyed(batch, grid, blocks):
                for cell in np.unique(key[np.isin(key, cells)]).tolist():
                    at = rows[key == cell]
                    for pivot in pivots[cell]:
                        own = pivot[1:].view(np.uint64)
                        close = at[_close(bits, at, np.broadcast_to(own, bits.shape), at, grid)]
                        found.update((x, int(pivot[0])) for x in node[close].tolist() if x != pivot[0])
            if found:
                yield _links(np.array(sorted(found), np.int64))

    return run


def _close(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray, grid: Grid) -> np.ndarray:
    """Whether rows ``i`` of ``one`` and ``j`` of ``two`` (rows x numbers) may be linked, as their bits tell.

    Sets with a Jaccard similarity of 0.8 or more differ in at most a ninth of their sizes'
    sum, so their sizes do, and so do their marks.
    """
    def apart(words: Iterable[int]) -> np.ndarray:
        distance = np.zeros(len(i), np.int64)
        for k in words:
            distance += np.bitwise_count(one[i, k] ^ two[j, k])
        return distance

    close = apart(range(grid.verify_words)) <= grid.max_bits
    if grid.marks:
        x, y = one[i, -1].view(np.int64), two[j, -1].view(np.int64)
        marks = apart(range(grid.verify_words, grid.verify_words + grid.marks))
        close &= 9 * np.maximum(np.abs(x - y), marks) <= x + y
    return close


def _near(cell, kind, label, bits, grid: Grid) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (row, later row) with other labels within cells, at most PAIRS compared at a time.

    Rows are sorted by cell, a cell's own rows first; rows of a step below are
    not compared among themselves, nor are rows of one side.
    """
    cut = np.flatnonzero(np.diff(cell)) + 1
    ends = np.concatenate((cut, [len(cell)]))
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    others = np.where(kind % 2 == 0, end - 1 - np.arange(len(cell)), 0)
    sums = np.concatenate(([0], np.cumsum(others)))
    at = 0
    while at < len(cell):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, "right")) - 1)
        n = others[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(sums[at:to] - sums[at], n) + i + 1
        one, two = kind[i] // 2, kind[j] // 2
        fit = (label[i] != label[j]) & ((one != two) | (one == 0))
        i, j = i[fit], j[fit]
        near = _close(bits, i, bits, j, grid)
        yield i[near], j[near]
        at = to


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> np.ndarray:
    """A link from every row to the smallest node that pairs connect it with."""
    root = np.arange(len(node))
    for i, j in pairs:
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    least = node.copy()
    np.minimum.at(least, root, node)
    least = least[root]
    moved = least != node
    return np.stack((node[moved], least[moved]), axis=1)


def _in_tiles(grid: Grid, solved):
    """``solved`` (near pairs, nodes) on rows sorted by cell, whole cells at a time."""

    def links(cell, kind, node, label, bits) -> Iterator[pa.RecordBatch]:
        found = solved(_near(cell, kind, label, bits, grid), node)
        for some in [found] if isinstance(found, np.ndarray) else found:
            if len(some):
                yield _links(some)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(grid.carried)], axis=1)
            part = (*(batch.column(c).to_numpy() for c in ("cell", "kind", "node", "label")), bits)
            if part[0][0] == part[0][-1] and (not held or held[0][0][0] == part[0][0]):
                held.append(part)
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held, part))
            last = _last_start(whole[0])
            if last:
                yield from links(*(x[:last] for x in whole))
            held = [tuple(x[last:] for x in whole)]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _last_start(cell: np.ndarray) -> int:
    """Where the last group of a sorted column begins."""
    other = np.flatnonzero(cell != cell[-1])
    return int(other[-1]) + 1 if len(other) else 0


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _tile_size(nodes: DataFrame, blocks: int) -> int:
    return min(LARGEST_TILE, max(LEAST_TILE, nodes.count() * blocks // 1000))


def _pivot_links(nodes: DataFrame, grid: Grid, blocks: int, tile: int) -> DataFrame | None:
    """Near pairs (a, b) of the rows of dense cells and a few pivots; None without such cells."""
    every = max(1, tile // SAMPLED)
    pivots = _pivots(_sample(nodes, grid, blocks, every), grid, tile // every)
    if not pivots:
        return None
    return keep(nodes.mapInArrow(_to_pivots(grid, blocks, pivots), "a bigint, b bigint").distinct(), "simhash-pivots")


def _relabelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    found = lookup_join(nodes.drop("label"), labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return keep(found.drop("root"), "simhash-labelled")


def _tiles(nodes: DataFrame, grid: Grid, blocks: int, tile: int) -> DataFrame:
    """Rows of all cells and tiles, dealt and sorted, a cell's own rows first."""
    every = max(1, tile // SAMPLED)
    by_label = _sample(nodes, grid, blocks, every).groupBy("cell", "label").agg(F.count("*").alias("n"))
    counted = by_label.groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    dense = {}
    # At most as many cells as the largest tile goes into all rows, or a thousand.
    for r in counted.where(F.col("n") > tile // every).collect():
        linked = r.top.n if r.top.n > 1 else 0
        dense[r.cell] = (r.top.label, -(-linked * every // tile), max(1, -(-(r.n - linked) * every // tile)))
    dealt = nodes.mapInArrow(_to_tiles(grid, blocks, dense), _schema(grid))
    return dealt.repartition("cell").sortWithinPartitions("cell", F.col("kind") % 2)


def near_links(nodes: DataFrame, grid: Grid = EXACT) -> DataFrame:
    """Links (a, b) that connect the fingerprints which near pairs connect.

    ``nodes``: node (number), fp (array of ``grid.words`` numbers), one row per
    distinct fingerprint.  Within a cell only one link for each row is returned,
    so a group of thousands of near copies does not turn into all its pairs.
    Rows of cells larger than a tile, as a sample tells, are first linked to a
    few pivots; what these connect is one label, and pairs of one label are not
    looked at again.  Such cells are cut into tiles of a set size.
    """
    nodes = nodes.select("node", "fp", F.col("node").alias("label"))
    tile = _tile_size(nodes, grid.blocks)
    first = _pivot_links(nodes, grid, grid.blocks, tile)
    if first is not None:
        nodes = _relabelled(nodes, components(first))
    found = _tiles(nodes, grid, grid.blocks, tile).mapInArrow(_in_tiles(grid, _joined), "a bigint, b bigint")
    return (found if first is None else found.union(first)).distinct()


def _distinct(raw: list[bytes], width: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(x, width)) for x in raw]


def fingerprints_of(sets: list[np.ndarray], words: int) -> np.ndarray:
    """:func:`fingerprint` of every set, sets x words, all sets summed at once."""
    out = np.zeros((len(sets), words), np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes, sizes = np.concatenate([sets[i] for i in full.tolist()]), sizes[full]
    # Runs of 255 hashes at most, as bytes hold their sums; each set has runs of its own.
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
    for k in range(words):
        part = _mix(hashes, k)
        count = np.zeros((len(full), 8, 8), np.int64)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & _LOW, starts)
            count[:, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = 2 * count.reshape(len(full), 64) > sizes[:, None]
        out[full, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def parity_marks(sets: list[np.ndarray], words: int) -> np.ndarray:
    """For every place of ``64 * words`` whether an odd number of a set's hashes fall on it, sets x words.

    Two sets' marks differ in at most as many places as there are hashes that only one of the sets has.
    """
    places = 64 * words
    out = np.zeros((len(sets), words), np.uint64)
    for at in range(0, len(sets), 1024):
        some = sets[at : at + 1024]
        place = (np.concatenate(some) >> np.uint64(32)) % np.uint64(places)
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        odd = np.bincount(row * places + place.astype(np.int64), minlength=len(some) * places) & 1
        out[at : at + 1024] = np.packbits(odd.astype(np.uint8).reshape(len(some), places), axis=1, bitorder="little").view(np.uint64)
    return out


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit name of each sorted set, as two numbers."""
    digests = b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _nodes_of(names: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """Half of the name; the other half for sets whose first half is not theirs alone."""
    return np.where(np.isin(names[:, 0], clashes), names[:, 1], names[:, 0])


def set_rows(docs: DataFrame, width: int, grid: Grid, names: tuple[str, ...]) -> DataFrame:
    """The columns ``names``, and name (s0, s1), size and fp of the distinct shingles, per row of ``docs`` (names, text).

    fp: the fingerprint, and what else rows in the cells of ``grid`` carry.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = _distinct(texts(batch.column("text")), width)
            named = set_names(sets)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            parts = [fingerprints_of(sets, grid.verify_words)]
            if grid.marks:
                parts += [parity_marks(sets, grid.marks), sizes.view(np.uint64)[:, None]]
            flat = np.concatenate(parts, axis=1).reshape(-1).view(np.int64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * grid.carried)
            columns = [pa.array(np.ascontiguousarray(named[:, k])) for k in range(2)]
            columns += [pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *columns], [*names, "s0", "s1", "size", "fp"]
            )

    kinds = ", ".join(f"{c} {k}" for c, k in docs.select(*names).dtypes)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, s0 bigint, s1 bigint, size bigint, fp array<bigint>")


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of at most COMMON shingles that very many texts hold, ascending by their number.

    Each piece of texts reports those it holds OFTEN times.  Which ones are found
    only decides how many candidates there are, never which pairs are found.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = _distinct(texts(batch.column("text")), width)
            hashes, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

    counted = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array([r.h for r in reversed(rows)], np.int64).view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of ``n`` sorted hashes the first ``n - ceil(0.8 n) + 1``, common ones last, the commonest at the very end.

    ``common``: sorted hashes, and their ``rank``.  Of two sets with a similarity
    of 0.8 or more, these share one.
    """
    n = len(hashes)
    length = n - -(-4 * n // 5) + 1 if n else 0
    if not len(common):
        return hashes[:length]
    place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    is_common = common[place] == hashes
    rare = hashes[~is_common]
    if len(rare) >= length:
        return rare[:length]
    late = np.flatnonzero(is_common)
    late = late[np.argsort(rank[place[late]], kind="stable")]
    return np.concatenate((rare, hashes[late[: length - len(rare)]]))


def _prefixes(width: int, common: np.ndarray, clashes: np.ndarray):
    rank = np.argsort(common)

    def run(batches) -> Iterator[pa.RecordBatch]:
        ordered = common[rank]
        for batch in pieces(batches, "text"):
            sets = _distinct(texts(batch.column("text")), width)
            nodes = _nodes_of(set_names(sets), clashes)
            first = [prefix(x, ordered, rank) for x in sets]
            each = np.repeat(nodes, [len(x) for x in first])
            hashes = np.concatenate(first).view(np.int64)
            for at in range(0, len(hashes), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at : at + (1 << 16)]), pa.array(each[at : at + (1 << 16)])], ["h", "node"]
                )

    return run


def _shared(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h and node, each once, those whose h has several nodes; holds one row between batches."""
    h, node, told = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.concatenate((h, batch.column("h").to_numpy()))
        node = np.concatenate((node, batch.column("node").to_numpy()))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (node[1:] == node[:-1])
        h, node = h[~again], node[~again]
        same = h[1:] == h[:-1]
        out = np.concatenate((same, [False])) | np.concatenate(([False], same))
        last = bool(out[-1]) or (told and len(h) == 1)
        if told:
            out[0] = False  # the row held was told with its batch
        yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(node[out])], ["h", "node"])
        h, node, told = h[-1:], node[-1:], last


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits at the places of hashed keys; of a set size, whatever the number of keys."""
    place = F.pmod(F.xxhash64(column), F.lit(64 * BITMAP_WORDS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = keys.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / 64).cast("int").alias("word"))
    bits = np.zeros(BITMAP_WORDS, np.int64)
    for r in words.agg(F.bit_or(bit).alias("bits")).collect():
        bits[r.word] = r.bits
    return bits.view(np.uint64)


def sets_of(docs: DataFrame, keys: DataFrame, width: int, clashes: np.ndarray) -> DataFrame:
    """(node, shingles) of the rows of ``docs`` (_key, text) with one of ``keys`` (_key), and of a few others."""
    wanted = _bitmap(keys, "_key")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            place = batch.column("place").to_numpy()
            on = (wanted[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(on.astype(bool)))
            if some.num_rows:
                sets = _distinct(texts(some.column("text")), width)
                begin = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(begin, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes_of(set_names(sets), clashes)), lists], ["node", "shingles"])

    place = F.pmod(F.xxhash64("_key"), F.lit(64 * BITMAP_WORDS)).alias("place")
    return docs.select("text", place).mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _pairs_listed(pairs: Iterator[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs, the smaller node first."""
    for i, j in pairs:
        yield np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1)


def _first_listed(pairs: Iterator[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> Iterator[np.ndarray]:
    """One pair of every row, with the first row that it is near to."""
    met = np.zeros(len(node), bool)
    for i, j in pairs:
        some = ~met[j]
        rows, at = np.unique(j[some], return_index=True)
        met[rows] = True
        others = i[some][at]
        yield np.stack((np.minimum(node[rows], node[others]), np.maximum(node[rows], node[others])), axis=1)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have a Jaccard similarity of 0.8 at least."""
    one = lookup_join(pairs.withColumnRenamed("a", "node"), sets, "node", "inner")
    one = one.select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("shingles").alias("_one"))
    both = lookup_join(one, sets, "node", "inner")
    common = F.size(F.array_intersect("_one", "shingles"))
    # common / (x + y - common) >= 4 / 5
    fit = (common > 0) & (9 * common >= 4 * (F.size("_one") + F.size("shingles")))
    return both.where(fit).select("a", F.col("node").alias("b"))


def similar_links(nodes: DataFrame, prefixes: DataFrame, sets_for, grid: Grid = SIMILAR, near: Grid = EXACT) -> DataFrame:
    """Links (a, b) that connect what pairs with a Jaccard similarity of 0.8 or more connect.

    ``nodes``: node and fp, one row per distinct set; ``prefixes``: node and prefix, the cells of those
    that share one; ``sets_for`` makes (node, shingles) of a table of nodes.  Candidates are pairs whose
    fingerprints are near by the grid ``near`` on their segments' counts and, as similar sets may differ in
    more bits, those that share a prefix's cell and are within ``grid``; each is compared exactly.  What a
    round of pivots for dense cells and a round of one pair for each row and cell connect is one label; then
    all pairs of two labels that share a prefix's cell are compared, so a group of near copies does not turn
    into all its pairs.
    """
    label = F.col("node").alias("label")
    dealt = nodes.select("node", F.slice("fp", 1, near.words).alias("fp"), label)
    nodes = lookup_join(nodes.select("node", "fp"), prefixes, "node", "inner").select("node", "fp", "prefix", label)
    nodes = keep(nodes, "simhash-met")
    rows = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    tile, near_tile = min(LARGEST_TILE, max(LEAST_TILE, rows // 1000)), _tile_size(dealt, near.blocks)

    def compared(found: DataFrame) -> DataFrame:
        pairs = keep(found.distinct(), "simhash-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = keep(sets_for(ends), "simhash-sets")
        links = keep(_similar(pairs, sets), "simhash-links")
        for table in (pairs, sets):
            forget(table)
        return links

    def listed(solved) -> DataFrame:
        return _tiles(nodes, grid, 0, tile).mapInArrow(_in_tiles(grid, solved), "a bigint, b bigint")

    links = []
    pivots = [_pivot_links(dealt, near, near.blocks, near_tile), _pivot_links(nodes, grid, 0, tile)]
    pivots = [p for p in pivots if p is not None]
    if pivots:
        links.append(compared(reduce(DataFrame.union, pivots)))
        roots = components(links[0])
        dealt, nodes = _relabelled(dealt, roots), _relabelled(nodes, roots)
    by_counts = _tiles(dealt, near, near.blocks, near_tile).mapInArrow(_in_tiles(near, _first_listed), "a bigint, b bigint")
    links.append(compared(by_counts.union(listed(_first_listed))))
    nodes = _relabelled(nodes, components(reduce(DataFrame.union, links)))
    links.append(compared(listed(_pairs_listed)))
    return reduce(DataFrame.union, links).distinct()


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all ``nodes``."""
    roots = lookup_join(nodes.select("node"), components(links), "node", "left")
    return roots.select("node", F.coalesce("root", "node").alias("root"))


def _rooted(fps: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """``fps`` (.., fp) with their node, and (node, root) of all distinct fingerprints."""
    node = F.col("fp")[0] if grid.words == 1 else F.xxhash64("fp")
    rows = fps.withColumn("node", node)
    nodes = keep(rows.groupBy("node").agg(F.min("fp").alias("fp")), "simhash-nodes")
    return rows, _roots(nodes, near_links(nodes, grid))


def simhash_groups(docs: DataFrame, width: int = 3, grid: Grid = EXACT) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links lead to, the document's own
    included; null ids are not the smallest of anything, so a group with null
    ids only has null.  Equal fingerprints are one node, however many rows have
    them; texts without words have fingerprint zero and are linked like any
    other.  Repeated rows stay; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows, roots = _rooted(keep(fingerprints(plain, width, grid.words), "simhash"), grid)
    ids = lookup_join(rows.groupBy("node").agg(F.min("doc_id").alias("least")), roots, "node", "inner")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lookup_join(roots, least, "root", "left").select("node", "component_id")
    return lookup_join(rows, named, "node", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, grid: Grid = SIMILAR) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies.

    Near copies are texts whose distinct shingles have a Jaccard similarity of
    0.8 or more, and what such pairs connect (:func:`similar_links`): found by
    the grid on their fingerprints' segment counts, and the rest by prefixes of their sets.
    Of each group the row with the smallest doc_id stays (nulls last), of
    several such rows the one whose text has the smallest MD5.  Null and empty texts are
    copies of each other; an empty table gives no rows.

    Texts are read where they are: once for the common shingles, once for names and
    fingerprints of their sets, once for their prefixes; those in candidate pairs are
    read once more in each of the rounds, for their sets.  Rows move as ids and hashes,
    but for the chosen ones.
    """
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.col("text").cast("binary")))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("_key"), F.col("text").cast("string").alias("text"))
    found = keep(set_rows(plain, width, grid, ("doc_id", "_key")), "simhash")
    # Different sets with one first half: none, or a few, by chance alone.
    several = found.select("s0", "s1", "size").distinct().groupBy("s0").count().where("count > 1")
    clashes = np.array([r.s0 for r in several.collect()], np.int64)
    node = F.when(F.col("s0").isin(clashes.tolist()), F.col("s1")).otherwise(F.col("s0")) if len(clashes) else F.col("s0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_key")).alias("_first")
    nodes = found.groupBy(node.alias("node")).agg(first, F.min("fp").alias("fp"))
    nodes = keep(nodes.select("node", "_first", F.col("_first._key").alias("_key"), "fp"), "simhash-nodes")
    forget(found)
    dealt = plain.mapInArrow(_prefixes(width, common_shingles(plain, width), clashes), "h bigint, node bigint")
    dealt = dealt.repartition("h").sortWithinPartitions("h", "node")
    cells = dealt.mapInArrow(_shared, "h bigint, node bigint").groupBy("node").agg(F.collect_list("h").alias("prefix"))

    def sets_for(ends: DataFrame) -> DataFrame:
        return sets_of(plain, lookup_join(ends, nodes.select("node", "_key"), "node", "inner"), width, clashes)

    links = keep(similar_links(nodes, cells, sets_for, grid), "simhash-similar")
    ids = lookup_join(nodes.select("node", "_first"), _roots(nodes, links), "node", "inner")
    chosen = ids.groupBy("root").agg(F.min("_first").alias("_first"))
    chosen = keep(chosen.select(F.col("_first._key").alias("_near_copy_key")), "simhash-chosen")
    # Rows repeated as a whole have one key and stay next to each other after the join.
    kept = docs.withColumn("_near_copy_key", key).join(chosen, "_near_copy_key", "left_semi")
    return kept.dropDuplicates(["_near_copy_key"]).select(*docs.columns)


def simhash_digest(groups: DataFrame) -> DataFrame:
    """64-bit fingerprints as hexadecimal digits."""
    digits = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")
