"""Token ids against whole-text encoding, and packing against its definition."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dealtrace.llm import packing as K
from dealtrace.llm.queries import LLM_QUERIES

from .conftest import FOLDER

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "",
    None,
    " \t\r\n ",
    "don't WE'RE it's 'S ''s \"'d 12a3 Éa",
    "İstanbul Σας ΣΑΣ é ﬁ ǅ ½²³ªºµ × ÷ ÿŸ",
    "<|endoftext|>a b<|startoftext|> c",
    "x　y 文字🙂 á ß ẞ STRASSE a\x00b\x1cc\x85d e ́f",
    "word," * 3000,
]


def expected(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_those_of_whole_texts(path, texts_of, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 500)
    texts = ODD + list(texts_of.values())
    encoder = K.Encoder(path)
    assert encoder.by_run == (path == WORDS)
    for some in (texts[:3], texts, texts[-40:], []):
        ids, sizes = encoder.batch(pa.array(some, pa.string()))
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == expected(path, some)


def checked(rows, capacity):
    """Sequences without gaps or overlaps, none above the capacity; returns how many."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(by)


def test_pieces_of_the_given_documents(spark, texts_of):
    rows = LLM_QUERIES["op12_sum_of_squares"](spark, FOLDER).collect()
    ids = dict(zip(texts_of, expected(WORDS, texts_of.values())))
    want = set()
    for doc_id, own in ids.items():
        own = [*own, 1]
        for piece, at in enumerate(range(0, len(own), 4096)):
            part = own[at : at + 4096]
            want.add((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert len(rows) == len(want) and {tuple(r[:5]) for r in rows} == want
    total = sum(r.length for r in rows)
    assert checked(rows, 4096) <= -(-total // 4096) + 1


def brute_place(levels, length, capacity):
    """The definition: try every level, count the squares anew; ties to the fullest; a new sequence last."""
    best = None
    for at, level in enumerate(levels):
        if level + length <= capacity and level < capacity:
            after = [*levels[:at], level + length, *levels[at + 1 :]]
            gaps = [capacity - x for x in after if x < capacity]
            cost = sum(gaps.count(g) ** 2 for g in set(gaps))
            if best is None or (cost, -level) < best[0]:
                best = ((cost, -level), level)
    return best[1] if best else 0


def test_every_piece_goes_where_the_squares_become_smallest():
    rng = random.Random(3)
    for capacity in (5, 12, 40):
        packer = K.SumOfSquares(capacity)
        for _ in range(120):
            length = rng.randint(1, capacity)
            want = brute_place(list(packer.levels), length, capacity)
            at, level = packer.place(length)
            assert level == want and packer.levels[at] == level + length
            open_now = [x for x in packer.levels if x < capacity]
            assert packer.count.sum() == len(open_now) == sum(map(len, packer.open))


def lengths(spark, values):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "doc_id long, length long")


def test_groups_together_need_few_more_sequences(spark):
    rng = np.random.default_rng(5)
    values = np.minimum(rng.lognormal(4.5, 1.0, 3000).astype(int) + 1, 1024)
    rows = K.pack(lengths(spark, values), capacity=1024, group=200).collect()
    assert sorted(r.length for r in rows) == sorted(values.tolist()) and len({r.doc_id for r in rows}) == 3000
    assert checked(rows, 1024) <= 1.005 * values.sum() / 1024 + 1


@pytest.mark.parametrize("value", [1, 512, 513, 1023, 1024])
def test_one_length_for_all(spark, value):
    rows = K.pack(lengths(spark, [value] * 2100), capacity=1024, group=500).collect()
    assert len(rows) == 2100
    assert checked(rows, 1024) <= -(-2100 // (1024 // value)) + (value == 1) * 5


def test_sequences_hold_the_documents_ids(spark, docs, texts_of):
    ids = {d: [*x, 1] for d, x in zip(texts_of, expected(WORDS, texts_of.values()))}
    rows = K.packed_sequences(docs, WORDS, capacity=512).collect()
    back = {}
    for r in rows:
        assert len(r.ids) == r.length <= 512
        for p in r.pieces:
            back.setdefault(p.doc_id, {})[p.start] = r.ids[p.offset : p.offset + p.length]
    assert {d: [i for s in sorted(x) for i in x[s]] for d, x in back.items()} == ids


def test_odd_rows(spark, odd_docs):
    rows = K.pack(K.token_pieces(odd_docs, WORDS, with_ids=False)).collect()
    checked(rows, 4096)
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == ["1", "1", "2", "3", "4", "6", "7", "None", "None"]
    assert all((r.length, r.ids_crc32) == (1, zlib.crc32(b"\x01\0\0\0")) for r in rows if r.doc_id in (2, 3, 4))
    assert K.pack(K.token_pieces(odd_docs.where("false"), WORDS, with_ids=False)).count() == 0
