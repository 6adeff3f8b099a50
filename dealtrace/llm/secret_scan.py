"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests lets pass.

Every long token is tested against being drawn evenly from the alphabet of its
encoding: chi-squared on the symbols, ranks of its letters by how common they
are, runs above and below the middle of the alphabet, and serial correlation.  Ordinary
text fails these tests.  A token that fails as a whole is tested by its parts
between separators, so that a key in a path is seen.  Which p-values count as
failed is settled over the whole corpus per class of length, by a step-up rule
that bounds the share of true random strings among the dismissed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul, ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, pieces, texts

# Patterns and least lengths.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")

# Lengths of a class, from here on; p-values are binned by their logarithm.
LENGTHS = (20, 28, 40, 64, 128)
BINS, BIN_WIDTH = 64, 0.25
FALSE_SHARE = 0.05

# A whole token with a lower p-value is tested by its parts, if any is long enough.
WHOLE = 1e-3
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LENGTHS[0])

# Fixed value: letters of English, the commonest first; words have more of the first ones than even draws.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
RANK = {c: i for i, x in enumerate(BY_FREQUENCY) for c in (x, x.upper())}

# From the narrowest alphabet on; every token fits the last one.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("Letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
ALPHABETS = [(name, letters, frozenset(letters)) for name, letters in ENCODINGS]

SCHEMA = (
    "doc_id bigint, base array<struct<kind:int, start:bigint, end:bigint>>,"
    " tested array<struct<start:bigint, end:bigint, encoding:string, stratum:int, bin:int, p:double, inside:boolean>>"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, code points, by start and then kind."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(x: float, freedom: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    a = 2 / (9 * freedom)
    return _upper_tail(((x / freedom) ** (1 / 3) - (1 - a)) / math.sqrt(a))


def infer_encoding(token: str) -> tuple[str, str]:
    """The first encoding, from the narrowest on, whose alphabet holds the token."""
    have = set(token)
    return next((name, letters) for name, letters, symbols in ALPHABETS if have <= symbols)


@lru_cache(maxsize=4096)
def _layout(alphabet: str, cells: int) -> tuple[dict[str, int], list[int]]:
    """Place of each symbol, and how many symbols fall to each cell."""
    width = [0] * cells
    for i in range(len(alphabet)):
        width[i * cells // len(alphabet)] += 1
    return {c: i for i, c in enumerate(alphabet)}, width


def common_letters_p(token: str) -> float:
    """Lower tail of the rank sum of its letters, of which each is as likely as any other."""
    ranks = [RANK[c] for c in token if c in RANK]
    if not ranks:
        return 1.0
    n, k = len(ranks), len(BY_FREQUENCY)
    # Ranks 0 to k - 1, drawn evenly: this mean and this spread, half a rank for steps of one.
    return _upper_tail((n * (k - 1) / 2 - sum(ranks) - 0.5) / math.sqrt(n * (k * k - 1) / 12))


def randomness_p(token: str, alphabet: str) -> float:
    """How well the token passes for even draws from the alphabet, 0 to 1.

    Five p-values (cells, equal symbols, ranks of letters, runs, serial
    correlation) are combined by five times the least one.
    """
    n, size = len(token), len(alphabet)
    # Several letters to a cell where the token is too short for one each.
    cells = max(2, min(size, n // 4))
    place, width = _layout(alphabet, cells)
    codes = [place[c] for c in token]
    counts = [0] * cells
    for c in codes:
        counts[c * cells // size] += 1
    x = sum((k - n * w / size) ** 2 / (n * w / size) for k, w in zip(counts, width))
    p_even = chi_squared_p(x, cells - 1)
    # As many equal letters as even draws would give.
    pairs = n * (n - 1) / 2
    same = sum(k * (k - 1) / 2 for k in Counter(codes).values())
    p_same = _upper_tail((same - pairs / size) / math.sqrt(pairs / size * (1 - 1 / size)))
    # Only an alphabet with all letters can tell common ones from rare ones.
    p_letters = common_letters_p(token) if size >= len(BY_FREQUENCY) else 1.0
    high = [c >= size / 2 for c in codes]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(map(ne, high, high[1:]))
        mean = 1 + 2 * up * down / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(codes) / n
    off = [c - middle for c in codes]
    power = sum(map(mul, off, off))
    if power:
        r = sum(map(mul, off, off[1:])) / power
        p_serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    else:
        p_serial = 0.0
    return min(1.0, 5 * min(p_even, p_same, p_letters, p_runs, p_serial))


def readings(token: str) -> list[tuple[int, str, str, float]]:
    """(place, string, encoding, p-value) of a token, or of its parts where it fails as a whole.

    Parts are runs of letters and digits, 20 at least; a part must do better than the whole.
    """
    name, letters = infer_encoding(token)
    p = randomness_p(token, letters)
    if p >= WHOLE:
        return [(0, token, name, p)]
    parts = []
    for m in PART.finditer(token):
        part, (kind, alphabet) = m.group(), infer_encoding(m.group())
        parts.append((m.start(), part, kind, randomness_p(part, alphabet)))
    better = [x for x in parts if x[3] > p]
    return better or [(0, token, name, p)]


def _tested(raw: bytes) -> Iterator[tuple[int, int, str, int, int, float]]:
    """(start, end, encoding, class of length, bin, p-value) of every long token, in code points."""
    before, at = 0, 0
    for m in TOKEN.finditer(raw):
        # Tokens are ASCII, so only the text since the last one is to be counted.
        at += len(raw[before : m.start()].decode())
        before = m.start()
        for place, token, encoding, p in readings(m.group().decode()):
            stratum = sum(len(token) >= x for x in LENGTHS) - 1
            level = min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN_WIDTH))
            yield at + place, at + place + len(token), encoding, stratum, level, p


def _inside(tested: list[tuple], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which tested strings meet a base span; both are walked once, in order."""
    merged: list[list[int]] = []
    for _, start, end in base:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    out, i = [], 0
    for start, end, *_ in tested:
        while i < len(merged) and merged[i][1] <= start:
            i += 1
        out.append(i < len(merged) and merged[i][0] < end)
    return out


def _scan(batches) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    tested_type = pa.list_(
        pa.struct(
            [
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("encoding", pa.string()),
                ("stratum", pa.int32()),
                ("bin", pa.int32()),
                ("p", pa.float64()),
                ("inside", pa.bool_()),
            ]
        )
    )
    for batch in pieces(batches, "text"):
        base, tested = [], []
        for raw in texts(batch.column("text")):
            fixed, strings = base_spans(raw.decode()), list(_tested(raw))
            base.append([dict(zip(("kind", "start", "end"), x)) for x in fixed])
            names = ("start", "end", "encoding", "stratum", "bin", "p", "inside")
            tested.append([dict(zip(names, (*x, y))) for x, y in zip(strings, _inside(strings, fixed))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(base, base_type), pa.array(tested, tested_type)],
            ["doc_id", "base", "tested"],
        )


def dismissal_levels(scanned: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Per class of length: the lowest bin of p-values that counts as failed.

    Step-up rule on binned p-values: with ``m`` tokens in the class and ``k`` of
    them at or below a bin's largest p-value, the bin is dismissed if that value
    is at most ``k / m * false_share``.  At most classes x bins rows.
    """
    counted = (
        scanned.select(F.explode("tested").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    )
    stratum = Window.partitionBy("stratum")
    sums = counted.select(
        "stratum", "bin", F.sum("n").over(stratum.orderBy(F.desc("bin"))).alias("k"), F.sum("n").over(stratum).alias("m")
    )
    largest = F.pow(F.lit(10.0), -F.col("bin") * F.lit(BIN_WIDTH))
    return (
        sums.where(largest <= F.col("k") / F.col("m") * F.lit(false_share))
        .groupBy("stratum")
        .agg(F.min("bin").alias("dismissed_from"))
    )


def secret_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): spans of secrets, by start and kind.

    ``base``: what the fixed patterns find; ``spans``: these and the random
    strings, kind 0 to 3 as in KINDS; code points, end exclusive.  A null or
    empty text has none; a null doc_id stays null; repeated rows stay repeated
    (and count as often in the p-values); other columns are not looked at; an
    empty table has no rows.  Work grows with a text's length, however long it
    is.  The texts are read once; what is found is written to the shared folder, as the
    levels of dismissal need the whole corpus before they can be applied.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = keep(plain.mapInArrow(_scan, SCHEMA), "secrets")
    # One number for each class of length, so five at most.
    levels = {r.stratum: r.dismissed_from for r in dismissal_levels(scanned, false_share).collect()}
    level = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(levels.items()))
    level = f"CASE x.stratum {level} ELSE {BINS} END" if levels else str(BINS)
    both = scanned.withColumn(
        "_random",
        F.expr(f"filter(tested, x -> x.bin < {level} AND NOT x.inside)"),
    )
    return both.select(
        "doc_id",
        "base",
        F.expr(
            "array_sort(concat(base, transform(_random, x -> named_struct('kind', 3, 'start', x.start, 'end', x.end))),"
            " (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE a.kind - b.kind END)"
        ).alias("spans"),
        F.col("_random").alias("random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with every span of :func:`secret_spans` replaced by ``mark``.

    Spans that touch or overlap are one.  A column n_chars is set to the new
    length; rows without spans stay as they are, a null text stays null, and an
    empty table has no rows.  Texts are read twice, for the
    levels of dismissal and for the replacement, and no row is moved.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = keep(plain.mapInArrow(_scan, SCHEMA), "secrets")
    levels = {r.stratum: r.dismissed_from for r in dismissal_levels(scanned, false_share).collect()}

    def clean(raw: bytes) -> str:
        text = raw.decode()
        spans = [x[1:] for x in base_spans(text)]
        spans += [x[:2] for x in _tested(raw) if x[4] < levels.get(x[3], BINS)]
        out, at = [], 0
        for start, end in sorted(spans):
            if start > at or not out:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = batch.column("text")
            new = [None if null else clean(raw) for raw, null in zip(texts(column), column.is_null().to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    replaced = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _written(spans: str) -> Column:
    kind = "CASE x.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return F.expr(f"array_join(transform({spans}, x -> concat({kind}, ':', x.start, ':', x.end)), ',')")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans, and all spans written out."""

    def count(kind: int) -> Column:
        return F.expr(f"size(filter(base, x -> x.kind = {kind}))").cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )
