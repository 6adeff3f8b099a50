"""Documents as token ids, packed into as few sequences of a set length as may be.

Sum-of-squares packing: a piece goes where the sum, over the residual gaps of
open sequences, of the squared number of sequences with that gap becomes
smallest; ties go to the fullest sequence.  Pieces come longest first, and a new
sequence is opened only where no open one has room, which measured fewer
sequences than weighing a new one against the others.

Pieces are dealt into groups of bounded size, each packed by one task.  What a
group leaves in sequences that are not well filled goes, with the same of other
groups, into fewer groups, until one is left or a round no longer helps.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces

CAPACITY, END_ID = 4096, 1
# Pieces that one task packs; rounds at most; the share of a sequence that ends its packing.
GROUP, ROUNDS, WELL_FILLED = 65_536, 8, 0.995
# Words and white-space-free runs a worker remembers the ids of.
REMEMBERED = 500_000

# Fixed value: how the tokenizer named in the contract parts words. It drops white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Texts in which NFC changes nothing and lower case is one letter for one; all their letters; the words in them.
_PLAIN_TEXT = "^[\t-\r -~À-ÖØ-öø-ÿ]*$"
_LETTERS = [chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """Token ids of texts by a tokenizer file, without added special tokens.

    Where the file's own rules drop white space and never look across it, each
    different run between white space is encoded once, word by word if the text
    has plain letters only; runs and words seen are remembered up to a bound.
    With any other file whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.added = [t["content"] for t in rules.get("added_tokens", [])]
        self.by_run = (
            steps[0].get("pattern") == {"Regex": WORD_SPLIT}
            and steps[0].get("invert") is True
            and [x["type"] for x in steps[1:]] == ["ByteLevel"]
            and [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and not rules.get("post_processor")
            and not any(re.search(r"\s", t) for t in self.added)
        )
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = str.maketrans({c: signs.pre_tokenize_str(c)[0][0] for c in _LETTERS})
        self.words: dict[str, bytes] = {}
        self.plain_runs: dict[str, bytes] = {"": b""}
        self.other_runs: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        signs = word if word.isascii() else word.translate(self.signs)
        return np.array([t.id for t in self.tokenizer.model.tokenize(signs)], "<u4").tobytes()

    def _split(self, runs: list[str]) -> list[bytes]:
        known, out = self.words, []
        if len(known) > REMEMBERED:
            known.clear()
        for run in runs:
            parts = _PLAIN_WORD.findall(run)
            for word in parts:
                if word not in known:
                    known[word] = self._word(word)
            out.append(b"".join([known[w] for w in parts]) if len(parts) > 1 else known[parts[0]])
        return out

    def _by_run(self, texts: pa.Array, seen: dict[str, bytes], learn) -> tuple[np.ndarray, np.ndarray]:
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(seen) + len(distinct) > REMEMBERED:
            seen.clear()
            seen[""] = b""
        new = [r for r in distinct if r not in seen]
        seen.update(zip(new, learn(new)))
        known = [seen[r] for r in distinct]
        stored = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        places = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], each)
        bounds = ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        return stored[places], np.diff(bounds)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.by_run:
            ids = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        plain = pc.match_substring_regex(texts, _PLAIN_TEXT)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(texts, token))
        flags = plain.to_numpy(zero_copy_only=False)
        if flags.all():
            return self._by_run(pc.utf8_lower(texts), self.plain_runs, self._split)
        plain_ids, plain_sizes = self._by_run(pc.utf8_lower(texts.filter(plain)), self.plain_runs, self._split)
        other_ids, other_sizes = self._by_run(texts.filter(pc.invert(plain)), self.other_runs, self._encode)
        sizes = np.empty(len(texts), np.int64)
        sizes[flags], sizes[~flags] = plain_sizes, other_sizes
        ids = np.empty(int(sizes.sum()), "<u4")
        of_plain = np.repeat(flags, sizes)
        ids[of_plain], ids[~of_plain] = plain_ids, other_ids
        return ids, sizes


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in pieces(batches, "text"):
            ids, counts = encoder.batch(batch.column("text"))
            rows, number, starts, sizes, sums, kept = [], [], [], [], [], []
            start = 0
            for row, end in enumerate(np.cumsum(counts).tolist()):
                own = np.append(ids[start:end], np.uint32(end_id)).astype("<u4")
                start = end
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(row)
                    number.append(piece)
                    starts.append(at)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part)
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(number, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (starts, sizes, sums)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


_KINDS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and ``end_id``, cut where longer than ``capacity``.

    ``docs``: doc_id, text; other columns are not read.  ``tokenizer`` is the path of a
    tokenizer file that the executors see.  An empty or null text is ``end_id`` alone;
    repeated rows are documents of their own, and so are rows without an id; an empty table
    gives no rows.  ``with_ids=False`` leaves the ids out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = _KINDS + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kinds)


class SumOfSquares:
    """Open sequences by how full they are, and where the next piece belongs."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences by level; 0 and full ones do not count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` ids."""
        # From level h to h + length the sum changes by 2 * (count[h + length] - count[h]) + 2;
        # a full sequence leaves the sum.  Level 0, a new sequence, comes after all that have room.
        last = self.capacity - length
        change = 2 * (self.count[length:] - self.count[: last + 1]) + 2
        change[last] -= 1
        change[self.count[: last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = np.iinfo(np.int64).max - 1
        level = last - int(np.argmin(change[::-1]))  # ties: the fullest
        if level:
            at = self.open[level].pop()
            self.count[level] -= 1
        else:
            at = len(self.levels)
            self.levels.append(0)
        filled = self.levels[at] = level + length
        if filled < self.capacity:
            self.count[filled] += 1
            self.open[filled].append(at)
        return at, level


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, longest first, and the level of each sequence."""
    packer = SumOfSquares(capacity)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        sequence[i], offset[i] = packer.place(int(lengths[i]))
    return sequence, offset, np.array(packer.levels, np.int64)


def _pack(capacity: int, turn: int, enough: float):
    def run(batches) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sequence, offset, levels = pack_lengths(table.column("length").to_numpy(), capacity)
        # A number of its own for every round, group and sequence.
        own = ((turn << 32 | TaskContext.get().partitionId()) << 24) + sequence
        done = levels[sequence] >= enough * capacity
        for name, column in (("sequence_id", own), ("offset", offset), ("done", done)):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches(8192)

    return run


def pack(pieces_: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset: ``length`` ids each, at most ``capacity`` in a sequence, without gaps.

    Pieces of ``capacity`` are sequences of their own.  The others, one row each
    whatever their ids, are dealt evenly into groups of about ``group`` rows; a frequent
    length or document is spread like all else.  Each round keeps the sequences that
    are filled to ``WELL_FILLED`` and packs the pieces of all others anew in fewer groups; the last
    round, when one group is left or a round shed less than a tenth, keeps all.  An empty table gives no rows.
    """
    stored = keep(pieces_, "pack-pieces")
    kinds = ", ".join(f"{n} {k}" for n, k in stored.dtypes) + ", sequence_id bigint, offset bigint, done boolean"
    whole = stored.where(F.col("length") >= capacity)
    # Numbers below 2^56, which no round uses.
    packed = [whole.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))]
    rest = stored.where(F.col("length") < capacity)
    left = rest.count()
    for turn in range(1, rounds + 1):
        groups = max(1, -(-left // group))
        put = keep(rest.repartition(groups).mapInArrow(_pack(capacity, turn, WELL_FILLED), kinds), "pack-round")
        loose = put.where("not done")
        after = loose.count() if groups > 1 and turn < rounds else 0
        if not after or after > 0.9 * left:
            packed.append(put.drop("done"))
            break
        packed.append(put.where("done").drop("done"))
        rest, left = loose.drop("sequence_id", "offset", "done"), after
    out = packed[0]
    for part in packed[1:]:
        out = out.unionByName(part)
    return out


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, length, ids, pieces): the packed sequences themselves, with the documents' pieces in order."""
    with_ids = keep(
        token_pieces(docs, tokenizer, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()), "pack-ids"
    )
    places = pack(with_ids.select("_row", "length"), capacity).drop("length")
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    gathered = with_ids.join(places, "_row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return gathered.select(
        "sequence_id",
        F.expr("aggregate(parts, 0L, (n, x) -> n + x.length)").alias("length"),
        F.flatten("parts.ids").alias("ids"),
        F.expr("transform(parts, x -> struct(x.doc_id, x.piece, x.start, x.length, x.offset))").alias("pieces"),
    )
