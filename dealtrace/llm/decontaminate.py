"""Benchmark passages in documents, by spaced seeds and a check that tolerates substitutions.

A mask says which of nine consecutive words count; the hash of those words is a
seed.  A changed word spoils only the seeds that look at it, so a passage with
some words exchanged still shares seeds with its benchmark item.  Every seed in
common fixes how item and document lie to each other, and the words are then
compared along that line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii

# Words that count (1) among consecutive ones; picked by simulation for the
# largest chance of a hit in 15 to 38 words of which every fifth is changed.
MASKS = ("111010011", "111100101", "110101011")
SPAN = len(MASKS[0])
# Seeds that the filter sent to all executors is sized for, 16 bits each (32 MB); of more it lets more through.
BLOCK_SEEDS = 1 << 24
# Bits of a cell of the filter and of a place in it; places that a number marks.
CELL_BITS, PLACE_BITS, PROBES = 4096, 12, 4
# Items of up to so many words are also cut into one piece more than words may differ; of a piece so many words count.
SHORT, PIECE = 15, 4
# Shorter items are common phrases in clean texts; with 1 every item is looked for.
SHORTEST = 4


def word_hashes(text: Column) -> Column:
    """XXH64 of every word: runs of ASCII letters and digits and all beyond ASCII, A-Z in lower case."""
    words = F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _seeds(at: Column, widths: list[int]) -> Column:
    """The seeds of all masks and of runs of ``widths`` words that begin at one place of h; null where the text ends before."""

    def of(number: int, counted: list[int]) -> Column:
        return F.when(at + counted[-1] < F.size("h"), F.xxhash64(F.lit(number), *(F.get("h", at + k) for k in counted)))

    masks = [of(n, [k for k, c in enumerate(mask) if c == "1"]) for n, mask in enumerate(MASKS)]
    return F.array(*masks, *(of(-w, list(range(w))) for w in widths))


def _placed(rows: DataFrame, widths: list[int], *columns: str) -> DataFrame:
    """One row per seed of ``rows`` (h), with the place of its first word."""
    # Outer: else the planner tests the array's size first, deep below and word by word anew.
    places = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)))
    each = rows.select(*columns, "h", F.explode_outer(places).alias("_p"))
    return each.select(*columns, "_p", F.explode_outer(_seeds(F.col("_p"), widths)).alias("seed"))


def _pieces(n: int, min_share: float) -> list[tuple[int, int]]:
    """(place, words) of the pieces of an item of ``n`` words, of which one is unchanged if the item counts as found."""
    k = min(n, int(n * (1 - min_share) + 1e-9) + 1)
    return [(i * n // k, min(PIECE, (i + 1) * n // k - i * n // k)) for i in range(k)]


def _item_seeds(items: DataFrame, lengths: list[int], min_share: float) -> tuple[DataFrame, list[int]]:
    """(item, _q, _seed) of all items, those of ``lengths`` by their pieces too; the pieces' numbers of words."""
    cut = {n: _pieces(n, min_share) for n in lengths}
    widths = sorted({w for at in cut.values() for _, w in at})
    whole = _placed(items.where(F.size("h") >= SPAN), [], "item")
    parts = [whole.where(F.col("seed").isNotNull()).select("item", F.col("_p").alias("_q"), F.col("seed").alias("_seed"))]
    for n, at in cut.items():
        runs = [
            F.struct(F.lit(p).alias("_q"), F.xxhash64(F.lit(-w), *(F.get("h", F.lit(p + k)) for k in range(w))).alias("_seed"))
            for p, w in at
        ]
        some = items.where(F.size("h") == n).select("item", F.explode(F.array(*runs)).alias("_x"))
        parts.append(some.select("item", "_x._q", "_x._seed"))
    return reduce(DataFrame.unionByName, parts), widths


def _cell(number: Column, cells: int) -> Column:
    return F.shiftrightunsigned(number, PLACE_BITS * PROBES).bitwiseAND(F.lit(cells - 1).cast("bigint"))


def _probes(number: Column) -> list[tuple[Column, Column]]:
    """Word and bit of the places that a number marks in its cell."""
    places = [F.shiftrightunsigned(number, PLACE_BITS * k).bitwiseAND(F.lit(CELL_BITS - 1).cast("bigint")).cast("int") for k in range(PROBES)]
    return [(F.shiftright(p, 6), p.bitwiseAND(63)) for p in places]


def _marked(numbers: DataFrame, count: int, most: int) -> tuple[DataFrame, int]:
    """A Bloom filter of ``numbers`` (one column of hashes) in cells of 64 words, of which it returns how many."""
    cells = 1 << min(16, max(0, -(-min(count, most) * 16 // CELL_BITS) - 1).bit_length())
    number, words = F.col(numbers.columns[0]), CELL_BITS // 64
    bits = [F.struct(w.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("b")) for w, b in _probes(number)]
    marks = numbers.select(_cell(number, cells).alias("_cell"), F.explode(F.array(*bits)).alias("x")).select("_cell", "x.w", "x.b")
    none = numbers.sparkSession.range(cells * words).select(
        F.floor(F.col("id") / words).alias("_cell"), (F.col("id") % words).cast("int").alias("w"), F.lit(0).cast("bigint").alias("b")
    )
    merged = none.unionByName(marks).groupBy("_cell", "w").agg(F.bit_or("b").alias("b"))
    of_cell = merged.groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x"))
    return of_cell.select("_cell", F.col("x.b").alias("_words")), cells


def _among(rows: DataFrame, column: str, numbers: DataFrame, count: int, most: int, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is among ``numbers``, and a few others; with ``left_anti`` those that surely aren't."""
    marked, cells = _marked(numbers, count, most)
    number = F.col(column)
    # The relation stays as it is sent, once for each executor; a look-up reads words of it in place.
    held = [F.getbit(F.get("_words", w), b) == 1 for w, b in _probes(number)]
    return rows.join(F.broadcast(marked), reduce(Column.__and__, held, _cell(number, cells) == F.col("_cell")), how)


def _lines(docs: DataFrame, items: DataFrame, lengths: list[int], min_share: float, most: int) -> DataFrame:
    """(_key, item, _at): where items may lie in the texts of ``docs`` (_key, h), for they have a seed in common there.

    ``_at`` is the place of the item's first word in the document.
    """
    found, widths = _item_seeds(items, lengths, min_share)
    of_items = keep(found, "benchmark-seeds")
    placed = _placed(docs, widths, "_key")
    some = _among(placed, "seed", of_items.select("_seed"), of_items.count(), most)
    hits = some.join(of_items, F.col("seed") == F.col("_seed"))
    return hits.select("_key", "item", (F.col("_p") - F.col("_q")).alias("_at")).distinct()


def _aligned(rows: DataFrame, min_run: int, min_share: float) -> DataFrame:
    """(doc_id, item, at_word, n_words, matched, run) of the lines (doc_id, h, item, _h, _at) on which the item counts as found."""
    # The part of the item inside the document.
    line = rows.withColumn("_from", F.greatest(F.lit(0), -F.col("_at"))).withColumn(
        "_n", F.least(F.size("_h"), F.size("h") - F.col("_at")) - F.col("_from")
    )
    same = F.zip_with(
        F.slice("h", F.col("_at") + F.col("_from") + 1, F.col("_n")),
        F.slice("_h", F.col("_from") + 1, F.col("_n")),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    compared = line.select("doc_id", "item", "_at", F.size("_h").alias("n_words"), same.alias("_same"))
    # The best stretch: an equal word adds 1, another takes 2 away, and below 0 it starts anew.
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    run = F.aggregate(
        "_same",
        start,
        lambda s, x: F.struct(
            F.greatest(F.lit(0), s["now"] + 3 * x - 2).alias("now"),
            F.greatest(s["best"], s["now"] + 3 * x - 2).alias("best"),
        ),
        lambda s: s["best"],
    )
    found = compared.withColumns({"run": run, "matched": F.aggregate("_same", F.lit(0), lambda s, x: s + x)})
    counts = found.where((F.col("run") >= min_run) | (F.col("matched") >= F.col("n_words") * F.lit(min_share)))
    whole = (F.col(c).cast("bigint").alias(c) for c in ("n_words", "matched", "run"))
    return counts.select("doc_id", "item", F.col("_at").cast("bigint").alias("at_word"), *whole)


def _best(found: DataFrame, *by: str) -> DataFrame:
    best = F.max(F.struct("matched", "run", (-F.col("at_word")).alias("_back"), "n_words")).alias("_best")
    return found.groupBy(*by).agg(best).select(
        *by,
        (-F.col("_best._back")).alias("at_word"),
        F.col("_best.n_words").alias("n_words"),
        F.col("_best.matched").alias("matched"),
        F.col("_best.run").alias("run"),
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    min_run: int = 13,
    min_share: float = 0.8,
    block_seeds: int = BLOCK_SEEDS,
    shortest: int = SHORTEST,
) -> DataFrame:
    """The benchmark items (item_id, text) found in documents (doc_id, text).

    One row per doc_id and item_id with the best alignment: at_word, the place
    in the document of the item's first word (below 0 if the item begins before
    the document), n_words of the item, matched words, and the best run.  An
    item counts as found if ``min_share`` of its words stand in line, or if the
    best run, in which a wrong word costs two right ones, reaches ``min_run``.

    The documents' seeds go through a Bloom filter of the benchmark's, sized for
    ``block_seeds`` of them at most and sent to all executors; what is left meets the
    benchmark by a shuffle, so no memory grows with either table.  Texts in which an
    item may lie are read again and compared.  Items of up to 15 words are found by
    their pieces too, which no change of a fifth of the words can all spoil; those of
    up to four words are one piece, so they are found where they stand unchanged, and
    those of fewer than ``shortest`` words are left out.  Null and empty texts, and
    items without a word, hold nothing; repeated rows and rows with one id, null
    included, give one result; empty tables give no rows.
    """
    # Texts are told apart by a hash; what is found is compared word by word, so equal hashes do no harm.
    text = F.col("text").cast("string")
    plain = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_key"))
    hashed = items.select("item_id", word_hashes(text).alias("h")).where(F.size("h") >= max(1, shortest))
    numbered = keep(hashed.distinct().withColumn("item", F.xxhash64("h")), "benchmark")
    texts = numbered.select("item", "h").distinct()
    # One row for each length up to 15.
    lengths = sorted(r.n for r in numbered.where(F.size("h") <= SHORT).select(F.size("h").alias("n")).distinct().collect())
    words = plain.select("_key", word_hashes(F.col("_text")).alias("h"))
    lines = keep(_lines(words, texts, lengths, min_share, block_seeds), "benchmark-lines")
    some = _among(plain, "_key", lines.select("_key").distinct(), lines.count(), block_seeds)
    # Both sides of this join have the columns h, so the items' is renamed.
    with_items = lines.join(texts.withColumnRenamed("h", "_h"), "item")
    met = some.select("doc_id", "_key", word_hashes(F.col("_text")).alias("h")).join(with_items, "_key")
    found = _best(_aligned(met, min_run, min_share), "doc_id", "item")
    # An item with several texts is one row.
    return _best(found.join(numbered.select("item", "item_id"), "item"), "doc_id", "item_id")


def without_leaks(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` (text and any others) in whose text :func:`leaks` finds no benchmark item.

    Texts are told apart by their MD5, so rows with one id or none are judged
    each by its own text.
    """
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    found = leaks(docs.select(key.alias("doc_id"), "text"), items, **limits)
    leaked = keep(found.select(F.col("doc_id").alias("_leak_key")).distinct(), "leaked")
    # Only texts that the filter doesn't clear are shuffled.
    numbers, count, most = leaked.select(F.xxhash64("_leak_key")), leaked.count(), limits.get("block_seeds", BLOCK_SEEDS)
    keyed = docs.withColumns({"_leak_key": key, "_leak_no": F.xxhash64(key)})
    clear = _among(keyed, "_leak_no", numbers, count, most, "left_anti")
    others = _among(keyed, "_leak_no", numbers, count, most).join(leaked, "_leak_key", "left_anti")
    return clear.select(*docs.columns).unionByName(others.select(*docs.columns))
