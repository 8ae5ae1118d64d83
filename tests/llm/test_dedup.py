"""Substring, MinHash and vector dedup against brute force, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from segflow.llm import minhash_dedup, pq_dedup, substring_dedup
from segflow.llm.components import connected_components
from segflow.llm.wordhash import SEGMENT

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_removed(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def passages(seed, n=60, vocabulary=40, width=6):
    r = random.Random(seed)
    vocab = [f"w{k}é" for k in range(vocabulary)]
    shared = [[r.choice(vocab) for _ in range(r.randint(width - 1, 3 * width))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(shared) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(0, 9))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [300, 10**6])
def test_passages_match_brute_force(spark, seed, bucket):
    rows = passages(seed)
    random.Random(seed).shuffle(rows)
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3), width=6, bucket_bytes=bucket).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_removed(rows, 6)
    for r in got:
        assert sum(b - a for a, b in r.removed) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))  # maximal: apart from each other


def test_passages_awkward_rows(spark):
    long = " ".join(f"x{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (5, long), (6, "y " + long), (None, long), (7, "one two")]
    frame = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA + ", hashes string, bucket int").repartition(3)
    got = substring_dedup.remove_repeated_passages(frame).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3000, 0), (5, 3000, 3000), (5, 3000, 3000), (6, 3001, 3000), (None, 3000, 0), (7, 2, 0)])
    assert substring_dedup.remove_repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def in_partitions(spark, parts):
    """One partition for each list of rows, in that order."""
    rows = [(k, *r) for k, part in enumerate(parts) for r in part]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "part int, " + SCHEMA).repartitionByRange(len(parts), "part").sortWithinPartitions("part", "doc_id").drop("part")


@pytest.mark.parametrize("other", [[f"y{k}" for k in range(55)], [f"y{k}" for k in range(200)]])
def test_rows_with_one_id_in_different_batches(spark, other):
    """A row that repeats a passage, and under the same id, elsewhere, a text that has nothing to do with it."""
    passage = [f"x{k}" for k in range(60)]
    first, again, alien = " ".join(passage), " ".join(["q"] * 100 + passage + ["z"]), " ".join(other)
    for parts in ([[(1, first), (2, again)], [(2, alien)], [(9, alien)]], [[(2, alien), (2, again), (1, first)], [(9, first + " " + alien)], [(2, again)]]):
        rows = [r for p in parts for r in p]
        got = substring_dedup.remove_repeated_passages(in_partitions(spark, parts)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_removed(rows, 50)


@pytest.mark.parametrize("seed", range(3))
def test_passages_with_repeated_ids_match_brute_force(spark, seed):
    rows = [(i % 25, t) for i, t in passages(seed, 80)]
    random.Random(seed).shuffle(rows)
    got = substring_dedup.remove_repeated_passages(in_partitions(spark, [rows[k::3] for k in range(3)]), width=6, bucket_bytes=400).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_removed(rows, 6)


def test_passages_in_texts_of_several_segments(spark):
    """Texts over the bytes that are hashed at once."""
    long = " ".join(f"word{k}" for k in range(400_000))
    assert len(long) > 2 * SEGMENT
    rows = [(1, long), (2, "new " + long[: len(long) // 2] + " end"), (3, "other words")]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_removed(rows, 50)


def brute_near(rows, percent):
    """For each row: its id, set size, least id reachable by links of any text under an id, and whether that is its own."""
    sets = []
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i), find(i) == i) for i, s in sets)


def near_copies(seed):
    r = random.Random(seed)
    vocab = [f"V{k}" for k in range(500)]
    rows = []
    for _ in range(8):
        base = [r.choice(vocab) for _ in range(r.choice([3, 40, 150]))]
        rows.append(base)
        for _ in range(r.randint(0, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append(copy)
    r.shuffle(rows)
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_match_brute_force(spark, seed):
    rows = near_copies(seed)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 85)


@pytest.mark.parametrize("seed", range(2))
def test_ids_with_several_texts_are_one_node(spark, seed):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, None), (11, c), (5, ""), (12, None), (20, c), (20, "one two")]
    if seed:
        rows += [(i % 40 + 100, t) for i, t in near_copies(7)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 85)


def test_near_copies_with_columns_that_have_no_order(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 2}), (2, "A b c d e f", {}), (3, "x", None)], SCHEMA + ", extra map<string,int>")
    left = minhash_dedup.drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    monkeypatch.setattr(minhash_dedup, "LEAVES", 3)
    rows = near_copies(5)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 85)


def test_sets_go_only_where_signatures_have_a_partner():
    least = minhash_dedup.least_matches(0.85, 1e-9, 120)
    r = np.random.default_rng(3)
    sigs = r.integers(0, 1 << 32, (40, 120), dtype=np.uint32)
    sigs[7, :110], sigs[21, :110] = sigs[3, :110], sigs[20, :110]
    comps = [20 if k == 21 else k for k in range(40)]  # 20 and 21 are connected already
    row = lambda k: {"band": 0, "bucket": 1, "t1": 0, "t2": 0, "side": 2, "rep": k, "component": comps[k], "sig": sigs[k].tobytes()}
    got = minhash_dedup._partners(least)(pa.Table.from_pylist([row(k) for k in range(40)]))
    assert sorted(got.column("rep").to_pylist()) == [3, 7]


def test_near_copies_awkward_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (3, text.upper()), (8, None), (9, ""), (None, text), (1, "one two"), (2, "ONE\ntwo"), (7, "one two three")]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", component_id int, rep int")
    got = Counter(tuple(r) for r in minhash_dedup.near_duplicates(frame).collect())
    want = [(5, 4, 3, False)] * 2 + [(3, 4, 3, True), (8, 0, 8, True), (9, 0, 9, True), (None, 4, None, False), (1, 1, 1, True), (2, 1, 1, False), (7, 1, 7, True)]
    assert got == Counter(want)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    left = minhash_dedup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 7, 8, 9]


def test_pruning_keeps_what_may_reach_the_threshold():
    least = minhash_dedup.least_matches(0.85, 1e-9, 120)
    assert (np.diff(least) >= 0).all() and least[120] < 0.85 * 120 and least[24] > 0
    sig = np.arange(240, dtype=np.uint32).reshape(2, 120)
    assert not minhash_dedup.likely_pairs(sig, sig, np.array([0]), np.array([1]), least)[0]
    assert minhash_dedup.likely_pairs(sig, sig, np.array([0]), np.array([0]), least)[0]


def test_bands_follow_the_threshold():
    assert (minhash_dedup.bands_for(85), minhash_dedup.bands_for(80), minhash_dedup.bands_for(100)) == (24, 35, 1)
    assert all((1 - (p / 100) ** 5) ** minhash_dedup.bands_for(p) <= 1e-6 for p in (50, 70, 80, 85, 90, 99))


def test_pipeline_stage_drops_copies_from_80_percent(spark, sf):
    rows = []
    for g in range(20):
        own = [f"v{k}g{g}" for k in range(104)]  # 100 shingles; similarity of the others: 95/105, 91/109 (0.835), 87/113 (0.77)
        others = [[*own[:52], "x", *own[53:]], [*own[:-9], *(f"z{k}" for k in range(9))], [*own[:40], *(f"y{k}" for k in range(9)), *own[49:]]]
        rows += [(10 * g + k, " ".join(w)) for k, w in enumerate([own, *others])]
    want = {i for i, _, _, kept in brute_near(rows, 80) if kept}
    assert want == {10 * g + k for g in range(20) for k in (0, 3)}
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    linked = {x for p in links if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_vectors(rows, threshold):
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if e is not None and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    parent = {i: i for i, _, _ in rows}
    count = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, la) in enumerate(good):
        for j, y, lb in good[a + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                count[i] += 1
                count[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (count[i], find(i), find(i) == i) for i, _, _ in rows}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 20)
    monkeypatch.setattr(pq_dedup, "CHUNK", 16)
    r = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 12)) if g else 60):
            rows.append([int(len(rows) * 13 % 1009), [float(x) for x in base + r.normal(size=16) * r.choice([0.1, 0.3])], int(g % 3)])
    rows += [[5001, None, 1], [5002, [0.0] * 16, 1], [5003, [None] * 16, 1], [5004, [float("nan")] * 16, 1], [5005, [float("inf")] * 16, 1], [5006, rows[0][1], None], [5007, [], 1], [5008, [3.0 * x for x in rows[0][1]], rows[0][2]]]
    for dim in (3, 2, 1):  # other dimensions in the same table
        rows += [[6000 + 100 * dim + k, [float(x) for x in r.normal(size=dim)], k % 2] for k in range(25)]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, side int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pq_dedup.near_duplicate_vectors(frame).collect()}
    assert got == brute_vectors(rows, 0.93)


def test_equal_vectors_count_as_often_as_they_occur(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 8)
    r = np.random.default_rng(5)
    bases = [[float(x) for x in r.normal(size=8)] for _ in range(6)]
    rows = []
    for b, base in enumerate(bases):
        for k in range((150, 40, 1, 2, 3, 0)[b]):
            rows.append([len(rows) * 7 % 1009, base, k % 2])
        rows += [[len(rows) * 7 % 1009 + 2000 + k, [x + 0.05 * float(r.normal()) for x in base], k % 2] for k in range(4)]
    rows += [[3000, [0.0, 1.0], 0], [3001, [-0.0, 1.0], 0], [3002, [0.0, 2.0], 0], [3003, [0.0, 1.0], 1]]  # signed zeros are equal
    rows += [[10, bases[1], 1]] if all(x[0] != 10 for x in rows) else []
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pq_dedup.near_duplicate_vectors(frame).collect()}
    assert got == brute_vectors(rows, 0.93)


def test_vectors_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pq_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [3.0, 0.0, 0.0], 1)]
    got = Counter(tuple(r) for r in pq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (3, 1, 3, True), (4, 1, 3, False)])
    bad = pq_dedup.near_duplicate_vectors(spark.createDataFrame([(4, None, 1)], schema)).collect()
    assert [tuple(r) for r in bad] == [(4, 0, 4, True)]


def test_vector_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pq_dedup.near_duplicate_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert got == brute_vectors(rows, 0.93)


@pytest.mark.parametrize("per_list", [75, 8])  # 20 and 187 lists
@pytest.mark.parametrize("kind", ["subspace", "spectrum"])
def test_no_link_is_lost_where_vectors_vary_in_few_directions(spark, monkeypatch, kind, per_list):
    monkeypatch.setattr(pq_dedup, "PER_LIST", per_list)
    r = np.random.default_rng(7)
    if kind == "subspace":
        x = r.normal(size=(1500, 6)) @ r.normal(size=(6, 64))
    else:
        x = r.normal(size=(1500, 64)) / np.arange(1, 65)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.93
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicate_vectors(frame).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(links.sum(1))}
    assert sum(got.values()) > 1500


def test_many_dimensions_send_few_vectors_to_the_driver(spark, monkeypatch):
    """Quantisers of rare dimensions make do with one vector or none; links are all found."""
    monkeypatch.setattr(pq_dedup, "SAMPLE", 20)
    rows = [(2 * d + k, [1.0] * d if k else [2.0] * d, 1) for d in range(1, 41) for k in (0, 1)]
    rows = rows + [(1000 + i, [1.0, 0.1 * i], 1) for i in range(3)]
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[2 * d] == got[2 * d + 1] == 1 for d in range(1, 41) if d != 2) and got[1000] >= 2
