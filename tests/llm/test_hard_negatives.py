"""Hard negatives against brute force, the Hilbert curve, and the bounds of zone maps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    best = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        q = tuple(math.floor(256 * x) for x in e)
        if sum(x * x for x in q) > H.MOST:
            continue
        best[i] = min(best.get(i, (label, q)), (label, q))
    out = []
    for a, (la, qa) in best.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, label) for i, (label, q) in best.items() if i != a and len(q) == len(qa))
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            fit = [(n, i) for n, i, label in scored if label != la and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def vectors(seed, n, dim, kind):
    r = np.random.default_rng(seed)
    if kind == "clusters":
        x = r.normal(size=(12, dim))[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, dim))
    elif kind == "ties":
        x = r.integers(0, 2, (n, dim)) / 4.0
    else:
        x = r.normal(size=(n, dim))
    return [(int(i), x[i].tolist(), int(r.integers(0, 10))) for i in r.permutation(n)]


@pytest.mark.parametrize(("kind", "dim"), [("clusters", 16), ("ties", 5), ("random", 24)])
def test_negatives_match_brute_force(spark, kind, dim):
    rows = vectors(1, 900, dim, kind)
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = vectors(2, 250, 4, "ties")
    rows += [
        (300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [float("nan")] * 4, 2), (600, [float("inf"), 0.0, 0.0, 0.0], 3),
        (None, [1.0, 0.0, 0.0, 0.0], 1), (700, [1.0, 0.0, 0.0, 0.0], None), (800, [], 1), (801, [], 1), (802, [], 2),
        (900, [0.0] * 4, 1), (1000, [1e30, 0.0, 0.0, 0.0], 1), (1100, [float(1 << 19)] * 4, 4), (1101, [float(1 << 19)] * 4, 4), (1102, [float(1 << 19) * 0.9] * 4, 5),
        (1200, [1.0, 2.0], -1), (1201, [1.0, 2.0], -1), (1202, [1.0, 1.5], 5), (100, [0.5] * 4, 3), (100, [0.25] * 4, 3), rows[0],
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("q", "dim", "bucket", "block", "score", "e")})
    assert sorted(map(tuple, H.hard_negatives(extra).collect())) == brute(rows)


def test_equal_vectors_spread_over_blocks(spark):
    """A third of all rows are one vector; its blocks are many, and the results those of brute force."""
    rows = vectors(3, 800, 6, "clusters")
    rows += [(1000 + i, rows[0][1], i % 10) for i in range(400)]
    assert mined(spark, rows, 5) == brute(rows)


def test_hilbert_curve_visits_neighbours():
    for dim, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim), -1).reshape(-1, dim)
        keys = H.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(keys)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_met():
    r = np.random.default_rng(5)
    a, rows = r.integers(-400, 400, (20, 9)), r.integers(-400, 400, (50, 9))
    least, most = H.score_bounds(a, rows.min(0)[None], rows.max(0)[None])
    scores = a @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    tight = H.score_bounds(a, rows, rows)
    assert np.abs(tight[0] - scores).max() < 2 and np.abs(tight[1] - scores).max() < 2


def test_scores_beyond_doubles_are_exact():
    a = np.array([[(1 << 27) - 1, 3, -7]])
    assert H.exact_scores(a, a)[0, 0] == sum(int(x) ** 2 for x in a[0])


def test_bounds_leave_most_blocks_unread(spark, monkeypatch):
    """On clustered vectors an anchor reads few blocks; every block is there to be read."""
    seen = []
    own = H.stage
    monkeypatch.setattr(H, "stage", lambda df, label: seen.append((label, own(df, label))) or seen[-1][1])
    monkeypatch.setattr(H, "discard", lambda *tables: None)
    monkeypatch.setattr(H, "BLOCK", 16)
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 8))[r.integers(0, 40, 6000)] + 0.01 * r.normal(size=(6000, 8))
    rows = [(i, v, i % 2) for i, v in enumerate(x.tolist())]
    H.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count()
    blocks = next(d for label, d in seen if label == "blocks").count()
    reads = [d.agg(F.sum(F.size("asked"))).first()[0] for label, d in seen if label == "reads"]
    assert blocks >= 6000 / 16
    assert reads[0] < 0.25 * 60 * blocks and reads[1] < 0.5 * 60 * blocks


@pytest.mark.parametrize("kind", ["ties", "random"])
def test_pages_and_lots_together_give_the_best(spark, monkeypatch, kind):
    for name, n in {"BLOCK": 32, "PAGE": 4, "PACK": 2, "SHELF": 3, "LOT": 12}.items():
        monkeypatch.setattr(H, name, n, raising=False)
    rows = vectors(7, 2400, 6, kind)
    assert mined(spark, rows) == brute(rows)


def test_chosen_blocks_are_numbers_and_not_broadcast(spark, monkeypatch):
    """What an anchor asks for is a few bytes, whatever its vector and windows, and no join that a small file feeds holds it in one piece."""
    seen = []
    own = H.stage
    monkeypatch.setattr(H, "stage", lambda df, label: seen.append((label, df._jdf.queryExecution().executedPlan().toString(), own(df, label))) or seen[-1][2])
    monkeypatch.setattr(H, "discard", lambda *tables: None)
    H.hard_negatives(spark.createDataFrame(vectors(8, 3000, 16, "random"), SCHEMA)).count()
    reads = [d.select(F.sum(F.length(F.to_json("asked"))), F.sum(F.size("asked"))).first() for label, _, d in seen if label == "reads"]
    assert len(reads) == 2 and all(n and chars <= 8 * n for chars, n in reads)
    plans = [plan for label, plan, _ in seen if label == "best"]
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)
