"""Fill-in-the-middle examples against a plain cut of whole texts, with frames far smaller than the texts."""

import hashlib
import re

import pytest
import zstandard

from dealtrace.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    "",
    " ",
    "\n\t one",
    "one  two three é ü 文字 🙂 end \r\n",
    "word " * 400,
    "x" * 5_000,
    " " * 300 + "y",
    "a <P> b",
    "<S>",
    "a <  P> < M>",
    "".join(f"w{i} é{i % 7}\n" for i in range(3_000)),
]


def plain_example(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, M.FRAME_BYTES])
def test_examples_equal_a_plain_cut(spark, frame_bytes):
    rows = [(i, ODD[i % len(ODD)]) for i in range(20 * len(ODD))] + [(None, "no id at all"), (5, None), (None, None)]
    framed = M.frame_texts(spark.createDataFrame(rows, "doc_id long, text string"), frame_bytes)
    examples = M.fill_middle(framed, frame_bytes=frame_bytes)
    want = sorted(((i, *plain_example(i, t)) for i, t in rows), key=str)
    texts = sorted(((r.doc_id, r.form, r.text) for r in M.fill_middle_texts(examples).collect()), key=str)
    assert texts == sorted(((w[0], w[2], w[5]) for w in want), key=str)
    digests = M.fill_middle_digest(examples).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((*r[:5], r.output_sha256, r.restored_sha256) for r in digests), key=str)
    assert got == sorted(((*w[:5], sha(w[5]), sha(old)) for w, old in zip(want, source(rows, want))), key=str)
    assert {r.form for r in digests} == {"plain", "psm", "spm"}


def source(rows, want):
    """The text behind each wanted row, whose parts are put in their old order again."""
    for _, _, form, _, _, out in want:
        if form == "plain":
            yield out
        else:
            cut = re.split("<[PSM]>", out)[1:]
            yield "".join(cut[i] for i in ((1, 2, 0) if form == "spm" else (0, 2, 1)))


def test_frames_seek_without_the_others(spark):
    text = "".join(f"w{i} " for i in range(5_000))
    frames = M.frame_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), 256).first().frames
    unpress, opened = zstandard.ZstdDecompressor(), []

    def open_frame(i):
        opened.append(i)
        return unpress.decompress(frames[i].data)

    units = UNIT.findall(text)
    for cut in (0, 1, 777, frames[3].units, len(units)):
        opened.clear()
        before, head, chars = M.split_at(frames, cut, open_frame)
        assert chars == len("".join(units[:cut])) and len(opened) <= 1
        whole = b"".join(unpress.decompress(f.data) for f in frames[:before])
        assert (whole + head).decode() == "".join(units[:cut])
    assert "".join(unpress.decompress(f.data).decode() for f in frames) == text


def test_uncut_frames_are_kept_as_they_are(spark):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(4_000))) for i in range(12)]
    framed = M.frame_texts(spark.createDataFrame(rows, "doc_id long, text string"), 512)
    stored = {r.doc_id: {f.data for f in r.frames} for r in framed.collect()}
    for r in M.fill_middle(framed, frame_bytes=512).collect():
        assert len(set(map(bytes, r.output)) - set(map(bytes, stored[r.doc_id]))) <= 6


def test_marks_across_chunks_are_found():
    press = zstandard.ZstdCompressor()
    example = "<P>a b<S> c d<M> e".encode()
    for size in (1, 2, 3, 5):
        frames = [press.compress(example[i : i + size]) for i in range(0, len(example), size)]
        assert b"".join(M.restored(frames, "psm", zstandard.ZstdDecompressor())) == b"a b e c d"


def test_odd_rows(spark, odd_docs):
    rows = M.fill_middle_digest(M.fill_middle(M.frame_texts(odd_docs))).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "3", "4", "6", "7", "None", "None"]
    ones = [r for r in rows if r.doc_id == 1]
    assert ones[0] == ones[1]
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n, r.form, r.output_sha256, r.restored_sha256) == (0, "plain", empty, empty) for r in rows if r.doc_id in (2, 3))
    assert M.fill_middle_digest(M.fill_middle(M.frame_texts(odd_docs.where("false")))).count() == 0
