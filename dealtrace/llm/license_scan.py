"""Short licence notices in texts, exact and with a few edits.

A notice with at most ``k`` edits keeps one of its ``k + 1`` pieces intact
(pigeonhole), so an exact search for the pieces finds every place worth a look;
there the ``regex`` library matches the whole notice with bounded errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, pieces, texts


@dataclass(frozen=True)
class Notice:
    """``must``: words that tell this notice from others, never edited."""

    label: str
    phrase: str
    must: tuple[str, ...] = ()
    errors: int = 0


# Notices looked for, with the words that tell them apart.
BASE = (
    Notice("mit", "under the mit license", ("mit",), 2),
    Notice("apache-2", "apache license version 2", ("apache", "2"), 2),
    Notice("cc-by-nc", "cc by nc"),
)
NOTICES = BASE + (
    Notice("apache", "licensed under the apache license", ("apache",), 3),
    Notice("gpl-2", "gnu general public license version 2", ("gnu", "2"), 3),
    Notice("gpl-3", "gnu general public license version 3", ("gnu", "3"), 3),
    Notice("lgpl", "gnu lesser general public license", ("gnu", "lesser"), 3),
    Notice("agpl", "gnu affero general public license", ("gnu", "affero"), 3),
    Notice("mpl-2", "mozilla public license version 2", ("mozilla", "2"), 3),
    Notice("bsd", "redistribution and use in source and binary forms", ("redistribution",), 4),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", ("attribution",), 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", ("attribution",), 3),
    Notice("public-domain", "released into the public domain", ("domain",), 2),
    Notice("reserved", "all rights reserved", ("rights",), 2),
)

SCHEMA = (
    "doc_id bigint, n_words bigint, spans array<struct<label:string, word:bigint, n_words:int,"
    " start:bigint, end:bigint, errors:int, score:double>>"
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def seeds(notice: Notice) -> list[tuple[bytes, int]]:
    """The pieces of a notice, with their places in it; the whole of it if no edit is allowed."""
    phrase, n = notice.phrase.encode(), notice.errors + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]


def _regions(text: bytes, notice: Notice, pieces_of: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """Stretches of ``text`` that can hold the notice, merged where they overlap."""
    slack, length = notice.errors + 1, len(notice.phrase.encode())
    found = []
    for seed, place in pieces_of:
        at = text.find(seed)
        while at >= 0:
            found.append((max(0, at - place - slack), at - place + length + slack))
            at = text.find(seed, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Scanner:
    """Finds notices in one text at a time."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = [
            (x, seeds(x), regex.compile(rb"(?e)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(x.phrase.encode()), x.errors)))
            for x in notices
        ]

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, edits, score) of every notice in a text of these words."""
        text = b" " + b" ".join(words) + b" "
        found = {}
        for notice, parts, pattern in self.notices:
            exact, length = b" " + notice.phrase.encode() + b" ", len(notice.phrase.encode())
            at, word, counted = text.find(exact), 0, 0
            while at >= 0:
                # Text before the phrase has one space for each word and the first one;
                # places rise, so only the text since the last one is counted.
                word, counted = word + text.count(b" ", counted, at), at
                found[(notice.label, word, notice.phrase.count(" ") + 1)] = (0, 1.0)
                at = text.find(exact, at + 1)
            if not notice.errors:
                continue
            must, word, counted = [x.encode() for x in notice.must], 0, 0
            for a, b in _regions(text, notice, parts):
                for m in pattern.finditer(text, a, b):
                    edits, inside = sum(m.fuzzy_counts), m.group().split(b" ")
                    if edits and all(x in inside for x in must):
                        word, counted = word + text.count(b" ", counted, m.start()), m.start()
                        key = (notice.label, word - 1, len(inside))
                        score = 1 - edits / length
                        if score > found.get(key, (0, 0.0))[1]:
                            found[key] = (edits, score)
        return sorted((label, word, n, e, s) for (label, word, n), (e, s) in found.items())


def code_points(raw: bytes, places: set[int]) -> dict[int, int]:
    """Code points before each of these byte places, counted in one walk over the text."""
    out, before, at = {}, 0, 0
    for place in sorted(places):
        at, before = at + len(raw[before:place].decode()), place
        out[place] = at
    return out


def _scan(notices: Sequence[Notice]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in pieces(batches, "text"):
            counts, spans = [], []
            for raw in texts(batch.column("text")):
                plain = raw.translate(PLAIN)
                words = plain.split()
                counts.append(len(words))
                hits = scanner.spans(words)
                if hits:
                    places = [m.span() for m in _WORD.finditer(plain)]
                    ends = {places[word][0] for _, word, *_ in hits}
                    at = code_points(raw, ends | {places[word + n - 1][1] for _, word, n, *_ in hits})
                    hits = [
                        {
                            "label": label,
                            "word": word,
                            "n_words": n,
                            "start": at[places[word][0]],
                            "end": at[places[word + n - 1][1]],
                            "errors": edits,
                            "score": score,
                        }
                        for label, word, n, edits, score in hits
                    ]
                spans.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, _SPANS)],
                ["doc_id", "n_words", "spans"],
            )

    return run


_SPANS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("word", pa.int64()),
            ("n_words", pa.int32()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("errors", pa.int32()),
            ("score", pa.float64()),
        ]
    )
)


def license_spans(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its word count and the notices in it.

    A span has the notice's label, its first word (from 0) and number of words,
    its code points in the text as given (end exclusive), the edits and a score,
    1 less the edits' share of the notice.  Words are runs of ASCII letters and
    digits and of all characters beyond ASCII, A-Z in lower case.  Edited notices
    begin and end with whole words.

    A null or empty text has no words and no spans; a null doc_id stays null;
    repeated rows stay repeated; other columns are not looked at; an empty table
    has no rows.  Work grows with a text's length, however long it is.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_scan(tuple(notices)), SCHEMA)


def license_digest(spans: DataFrame, base: Sequence[Notice] = BASE) -> DataFrame:
    """Per document: places of the base notices, their ends, labels and the best score.

    A base place is one without edits.  Without any, the words are null, the
    labels empty and the score 0.
    """
    exact = " OR ".join(
        f"(x.label = '{n.label}' AND x.n_words = {n.phrase.count(' ') + 1} AND x.errors = 0)" for n in base
    )
    based = spans.withColumn("_base", F.expr(f"filter(spans, x -> {exact})"))
    words = F.expr("transform(_base, x -> x.word)")

    def joined(column: str):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.expr(f"transform({column}, x -> x.label)"))))

    return based.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(spans, x -> x.score)")), F.lit(0.0)).alias("score"),
    )
