"""Neighbours, repeated windows, leaks and near copies against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dealtrace.llm import components as K
from dealtrace.llm import decontaminate as D
from dealtrace.llm import nearest as N
from dealtrace.llm import simhash as H
from dealtrace.llm import substring_dedup as R

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_neighbours_reach_the_recall(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    length = np.sqrt((x * x).sum(1))
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for i in np.flatnonzero(ids % 10 == 0):
        cosine = (x * x[i]).sum(1) / (length * length[i])
        best = sorted((-c, v) for c, v in zip(cosine.tolist(), ids.tolist()) if v != ids[i])[:5]
        mine = got[int(ids[i])]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert [s for _, (_, s) in sorted(mine.items())] == sorted((s for _, s in mine.values()), reverse=True)
        assert all(math.isclose(s, cosine[ids == v][0], abs_tol=1e-12) for v, s in mine.values())
        hits += len({v for _, v in best} & {v for v, _ in mine.values()})
    assert hits / (5 * len(got)) >= 0.9


def test_odd_vectors_and_many_equal_ones(spark):
    nan, same = float("nan"), [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)] + [(100, [0.0] * 3), (101, [nan, 1.0, 1.0]), (102, None)]
    rows += [(103, [1.0, None, 2.0]), (104, [1.0]), (None, same), (105, [-1.0, -2.0, -3.0]), (0, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest(df, F.col("vec_id").isin(0, 39, 100, 105)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert {q: [v for _, v, _ in sorted(x)] for q, x in got.items()} == {
        0: [1, 2, 3, 4, 5],
        39: [0, 1, 2, 3, 4],
        105: [0, 1, 2, 3, 4],
    }
    two = N.nearest(df.where("vec_id IN (1, 105)"), F.col("vec_id") > 0).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in two) == [(1, 105, 1), (105, 1, 1)]
    assert N.nearest(df.where("false"), F.lit(True)).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(N.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def removed(texts, window):
    seen = {}
    words = [WORDS.findall(t or "") for t in texts]
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [R.BUCKET, 2])
def test_repeated_windows_equal_brute_force(docs, texts_of, bucket):
    want = dict(zip(texts_of, removed(texts_of.values(), 35)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in R.remove_repeats(docs, bucket=bucket).collect()}
    assert got == want and sum(x[1] for x in want.values())


@pytest.mark.parametrize("bucket", [R.BUCKET, 3])
def test_a_hot_passage_and_loops(spark, bucket):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(400)}"
    hot = " ".join(word() for _ in range(30))
    texts = [" ".join([*(word() for _ in range(draw.randrange(20))), hot, *(word() for _ in range(9))]) for _ in range(60)]
    texts += ["a b " * 40, "x " * 30, "x " * 12, texts[0], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = R.remove_repeats(df, 12, bucket).collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)] == removed(texts, 12)


def test_leaks_are_found_and_others_left_alone(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    plain = lambda t: " " + " ".join(word.findall(t.encode().lower().decode())) + " "
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, i.item_id) for d, t in texts.items() for i in items.collect() if plain(i.text) in t}
    got = D.leaks(docs, items).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in got if r.matched == r.n_words}
    # In blocks of few seeds the result is the same.
    assert sorted(map(tuple, D.leaks(docs, items, block_seeds=500).collect())) == sorted(map(tuple, got))


def test_exchanged_words_parts_and_short_items(spark):
    item = [f"word{i}" for i in range(30)]
    changed = [w if i % 6 != 3 else "other" for i, w in enumerate(item)]
    shifted = item[:15] + ["inserted"] + item[15:]
    rows = [
        (1, "before " + " ".join(changed) + " after"),
        (2, " ".join(shifted)),
        (3, " ".join(item[:14])),
        (4, " ".join(item[:9]) + " and so on to other things"),
        (5, " ".join(w for i, w in enumerate(item) for w in (w, "x"))),
        (None, " ".join(item)),
        (7, None),
        (8, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "word1 word2 word3"), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(df, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert (got[1, 1].at_word, got[1, 1].matched, got[1, 1].n_words) == (1, 25, 30)
    kept = D.without_leaks(df, items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8] and kept.columns == df.columns
    assert D.leaks(df, items.where("false")).count() == 0 == D.leaks(df.where("false"), items).count()


def simhash(text, width=3):
    words = WORDS.findall((text or "").encode().lower().decode())
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_fingerprints_equal_brute_force(spark, docs, texts_of):
    fps = {d: simhash(t) for d, t in texts_of.items()}
    got = {r.doc_id: r for r in H.simhash_digest(H.simhash_groups(docs)).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == smallest(fps, 3)


def smallest(fps, bits):
    label = {d: d for d in fps}
    changed = True
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= bits]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_links_of_dense_random_fingerprints(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(12)]
    fps = {}
    for i in range(500):
        x = base[i % 12]
        for _ in range(draw.randrange(6)):
            x ^= 1 << draw.randrange(64)
        fps[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    least = {}
    for i, x in fps.items():
        least.setdefault(x, i)
    nodes = spark.createDataFrame([(signed(x), [signed(x)]) for x in least], "node long, fp array<long>")
    links = H.near_links(nodes).collect()
    assert len(links) < 2.5 * len(least)
    by_id = {signed(x): i for x, i in least.items()}
    want = smallest({i: x for x, i in least.items()}, 3)
    found = {i: i for i in want}
    for _ in range(len(links) + 1):
        before = dict(found)
        for a, b in links:
            low = min(found[by_id[a]], found[by_id[b]])
            found[by_id[a]] = found[by_id[b]] = low
        if found == before:
            break
    assert found == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(7, 7), (500, 499)]
    got = {r.node: r.root for r in K.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}, 500: 499, 499: 499}


def test_one_of_each_group_of_near_copies_stays(spark):
    draw = random.Random(1)
    text = [f"w{draw.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(w if j != i * 7 else "changed" for j, w in enumerate(text)), "s") for i in range(20, 26)]
    other = [(i, " ".join(f"v{draw.randrange(5000)}" for _ in range(200)), "s") for i in range(8)]
    rows = rows + [rows[0]] + other + [(None, " ".join(text), "s"), (50, None, "s"), (51, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = H.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), 20, 50]


def test_a_dense_cell_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAST_TILE", 32)
    monkeypatch.setattr(H, "LARGEST_TILE", 32)
    monkeypatch.setattr(H, "SAMPLED", 32)
    draw = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base, fps = draw.getrandbits(64), set()
    # Half of them around one fingerprint, and chains that lead away from it; other halves differ wholly.
    while len(fps) < 300:
        x = base
        for _ in range(draw.choice((1, 2, 3, 5, 9))):
            x ^= 1 << draw.randrange(32)
        fps.add(x)
    fps |= {(draw.getrandbits(32) << 32) | (base & 0xFFFFFFFF) for _ in range(100)}
    want = smallest({x: x for x in fps}, 3)
    nodes = spark.createDataFrame([(signed(x), [signed(x)]) for x in fps], "node long, fp array<long>")
    plain = nodes.select("node", "fp", F.col("node").alias("label"))
    first = H._pivot_links(plain, H.EXACT, 2, 32)
    for labelled in (plain, H._relabelled(plain, K.components(first))):
        tiles = H._tiles(labelled, H.EXACT, 2, 32)
        assert tiles.groupBy("cell").count().agg(F.max("count")).first()[0] <= 160
    links = [(r.a, r.b) for r in H.near_links(nodes).collect()]
    root = {signed(x): signed(x) for x in fps}
    for _ in range(len(fps)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    groups = lambda f: sorted(sorted(signed(x) for x in fps if f(x) == k) for k in {f(x) for x in fps})
    assert groups(lambda x: root[signed(x)]) == groups(want.get)


def test_near_copies_equal_brute_force_about_the_threshold(spark):
    draw = random.Random(11)
    texts, n = [], 0
    for _ in range(120):
        words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        # Every changed word spoils five shingles; 0.75 to 0.9 lies at 3 to 9 changes.
        for at in draw.sample(range(0, 300, 6), draw.randrange(3, 10)):
            other[at] = f"x{draw.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    sets = [{t[i : i + 5] for i in range(296)} for t in (tuple(x.split()) for x in texts)]
    sets = [{" ".join(s) for s in x} for x in sets]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in H.keep_one(df).select("doc_id").collect()}
    assert all(2 * k in kept for k in range(120))
    linked = [2 * k + 1 not in kept for k in range(120)]
    assert not any(x and s < 0.8 for x, s in zip(linked, similar))
    near = [x for x, s in zip(linked, similar) if s >= 0.8]
    assert 40 < len(near) < 120 and all(near)


def test_bit_counts_of_many_hashes():
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 70_001, np.uint64)
    bits = [sum((x >> b) & 1 for x in hashes[:1000].tolist()) for b in range(64)]
    assert int(H.fingerprint(hashes[:1000])[0]) == sum(1 << b for b in range(64) if 2 * bits[b] > 1000)
    whole = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    assert int(H.fingerprint(hashes)[0]) == sum(1 << b for b in range(64) if 2 * whole[b] > len(hashes))


def test_short_items_are_found_with_a_fifth_exchanged(spark):
    draw = random.Random(2)
    items, rows, want = [], [], set()
    for n in range(4, 16):
        for turn in range(8):
            item = [f"i{n}x{turn}x{k}" for k in range(n)]
            spoilt = draw.sample(range(n), n // 5 + (turn == 7))
            text = ["before", *(f"other{k}" if k in spoilt else w for k, w in enumerate(item)), "after"]
            items.append((100 * n + turn, " ".join(item)))
            rows.append((100 * n + turn, " ".join(text)))
            if turn < 7:
                want.add((100 * n + turn, 100 * n + turn, 1, n, n - n // 5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.at_word, r.n_words, r.matched) for r in found) == sorted(want)


def test_fingerprints_of_many_sets_equal_those_one_by_one():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 2, 5, 254, 255, 256, 511, 3000, 0, 7)]
    assert (H.fingerprints_of(sets, 4) == np.stack([H.fingerprint(x, 4) for x in sets])).all()
    assert not H.fingerprints_of([sets[0]], 4).any()


def test_prefixes_of_similar_sets_share_a_shingle():
    draw = random.Random(5)
    common = np.array(sorted(draw.sample(range(2000), 600)), np.uint64)
    rank = np.array(draw.sample(range(600), 600))
    met = 0
    for _ in range(4000):
        n = draw.randrange(1, 60)
        one = set(draw.sample(range(2000), n))
        other = set(draw.sample(sorted(one), max(1, n - draw.randrange(0, 1 + n // 4)))) | set(draw.sample(range(2000), draw.randrange(0, 1 + n // 6)))
        if len(one & other) * 5 >= 4 * len(one | other):
            met += 1
            a, b = (H.prefix(np.array(sorted(x), np.uint64), common, rank) for x in (one, other))
            assert set(a.tolist()) & set(b.tolist())
    assert met > 500
    assert len(H.prefix(np.array([3, 5, 9], np.uint64), common, rank)) == 1


def test_only_shared_shingles_pass_whatever_the_batches():
    draw = random.Random(6)
    rows = sorted((draw.randrange(40), draw.randrange(12)) for _ in range(120)) + [(50, 1), (50, 1), (60, 2), (60, 3)]
    by = {}
    for h, node in rows:
        by.setdefault(h, set()).add(node)
    want = sorted((h, n) for h, nodes in by.items() if len(nodes) > 1 for n in nodes)
    for size in (1, 2, 3, 7, 200):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"h": [h for h, _ in x], "node": [n for _, n in x]}) for x in parts]
        got = [(h, n) for b in H._shared(batches) for h, n in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == want


def test_a_group_of_thousands_of_near_copies(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[draw.randrange(120)] = f"x{i}"
        rows.append((i + 10, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(i, f"{passage} " + " ".join(f"v{draw.randrange(10**6)}" for _ in range(200))) for i in range(4000, 4400)]
    kept = {r.doc_id for r in H.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {10, *range(4000, 4400)}


def test_marks_differ_no_more_than_sets():
    draw = np.random.default_rng(12)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 9, 150, 3000) for _ in range(6)]
    sets += [np.unique(np.concatenate((x[: -max(1, len(x) // 9)], draw.integers(0, 1 << 64, len(x) // 12, np.uint64)))) for x in sets]
    marks = H.parity_marks(sets, H.MARKS)
    bits = np.concatenate((H.fingerprints_of(sets, 4), marks, np.array([[len(x)] for x in sets], np.uint64)), axis=1)
    similar = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert np.bitwise_count(marks[i] ^ marks[j]).sum() <= len(x) + len(y) - 2 * both
            if both and 5 * both >= 4 * (len(x) + len(y) - both):
                similar += 1
                assert H._close(bits, np.array([i]), bits, np.array([j]), H.SIMILAR).all()
    assert similar > 60


def test_a_group_below_the_threshold_is_not_compared_pair_by_pair(spark, monkeypatch):
    draw = random.Random(13)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(2, 148, 6), 3):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    sets = [{" ".join(w[i : i + 5]) for i in range(146)} for w in (t.split() for t in texts)]
    root = list(range(300))
    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (292 - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    made, seen = H.keep, []
    monkeypatch.setattr(H, "keep", lambda df, label: seen.append((label, made(df, label))) or seen[-1][1])
    monkeypatch.setattr(H, "forget", lambda df: None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in H.keep_one(df).select("doc_id").collect()}
    assert kept == set(root) and 100 < len(kept)
    # 44,850 pairs share a cell.
    assert sum(pairs.count() for label, pairs in seen if label == "simhash-pairs") < 10 * 300


def test_near_segment_counts_make_candidates_without_a_shared_prefix_cell(spark):
    draw = random.Random(14)
    text = [f"w{draw.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(text), " ".join([*text[:-1], "other"]), " ".join(f"v{draw.randrange(10**6)}" for _ in range(300))]
    sets = [np.unique(H.shingle_hashes(t.encode(), 5)) for t in texts]
    assert np.bitwise_count(H.fingerprints_of(sets[:2], 1)[0] ^ H.fingerprints_of(sets[:2], 1)[1])[0] <= 3
    carried = np.concatenate((H.fingerprints_of(sets, 4), H.parity_marks(sets, H.MARKS), np.array([[len(x)] for x in sets], np.uint64)), axis=1)
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(carried.view(np.int64).tolist())], "node long, fp array<long>")
    shingles = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "node long, shingles array<long>")
    none = spark.createDataFrame([], "node long, prefix array<long>")
    assert [(r.a, r.b) for r in H.similar_links(nodes, none, lambda ends: shingles).collect()] == [(0, 1)]
