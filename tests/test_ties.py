"""Rules at their very limit, and block products against the plain formula."""

import numpy as np
import pandas as pd

from tessera.operators import frames as O
from tessera.operators import picks as P
from tessera.operators import spans as S
from tessera.plans import registry

QUERIES, ORACLES = registry.load()


def test_a_mean_at_the_limit_draws_no_note(spark, duck, tmp_path):
    # the mean of these over 50 is 0.51; added as doubles it is more
    quantity = [14.0, 46.0, 32.0, 10.0]
    pd.DataFrame({"l_orderkey": range(4), "l_linenumber": range(4), "l_suppkey": 1, "l_quantity": quantity, "l_discount": 0.05, "l_tax": 0.01}).to_parquet(tmp_path / "lineitem.parquet")
    got = [tuple(r) for r in QUERIES["c41_caveats"](spark, str(tmp_path)).collect()]
    con = duck.cursor()
    con.execute(f"create temp view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert got == [(1, "")] == con.execute(ORACLES["c41_caveats"]).fetchall()


def test_votes_whose_mean_is_the_threshold_are_not_under_it(spark):
    # the votes of rows 0, 2 and 4 have a mean of 0.38; added as doubles it is less
    rows = [(1, i, "ann", v) for i, v in enumerate([0.4587, 0.9, 0.5061, 0.9, 0.1752, 0.9])]
    df = spark.createDataFrame(rows, "k int, i int, label string, v double")
    due = {r.i: r.due for r in S.reid_due(df, "k", "i", "label", "v", interval=2).collect()}
    assert due == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_labels_far_below_the_best_keep_their_rank(spark):
    df = spark.createDataFrame([(1, [-3000.0, 900.0, -1000.0, -2000.0])], "k int, x array<double>")
    got = sorted((r["rank"], r.label, r.p) for r in S.top_labels(df, ["k"], "x", ["a", "b", "c", "d"]).collect())
    assert got == [(1, "b", 1.0), (2, "c", 0.0), (3, "d", 0.0)]


def test_top_labels_of_large_keys_equal_their_sql(spark, duck, tmp_path):
    pd.DataFrame({"event_id": np.arange(5), "user_id": [90_000, 80_000, 3, 40_000, 1], "value": [2.0, 900.0, 40_000.0, 5.0, 1.0]}).to_parquet(tmp_path / "events.parquet")
    con = duck.cursor()
    con.execute(f"create temp view events as select * from '{tmp_path}/events.parquet'")
    key = lambda r: (r[0], r[3])
    got = sorted((tuple(r) for r in QUERIES["o22_top_labels"](spark, str(tmp_path)).select("event_id", "label", "p", "rank").collect()), key=key)
    assert got == sorted(con.execute(ORACLES["o22_top_labels"]).fetchall(), key=key)


def vectors(spark, n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x[5], x[7] = x[4], 0.0
    return x, spark.createDataFrame([(i, i % 3, i // 4, i, v.tolist()) for i, v in enumerate(x)], "id long, video int, shot int, frame_index int, embedding array<double>")


def test_search_pairs_no_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PASS", 16)
    x, df = vectors(spark, 90, 6, 1)
    out = P.knn(df.where("id % 2 = 0"), df, 4, "id", "id")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    want = {(q, i, r + 1) for q in range(0, 90, 2) for r, i in enumerate(sorted((i for i in range(90) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4])}
    assert {(r.query, r.id, r["rank"]) for r in out.collect()} == want


def test_novelty_pairs_no_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "pick_cells", None)
    x, df = vectors(spark, 90, 6, 2)
    picks = df.where("frame_index % 10 = 0")
    got = {r.video: (r.shots, r.n_missed, round(r.mean_novelty, 9)) for r in P.novelty_missed(df, picks, "video", "shot").collect()}
    for v in range(3):
        mine, chosen = [i for i in range(90) if i % 3 == v], [i for i in range(0, 90, 10) if i % 3 == v]
        shots = {}
        for i in mine:
            shots.setdefault(i // 4, []).append(max(float(x[i] @ x[j]) for j in chosen))
        novelty = [min(1.0, max(0.0, 1 - min(b))) for b in shots.values()]
        assert got[v] == (len(novelty), sum(n > 0.15 for n in novelty), round(sum(novelty) / len(novelty), 9))


def test_transitions_of_all_keys_are_matched_in_one_pass(spark):
    rows = [(k, i, (i * 7 + k) % 10 / 10, i % 4 == 0) for k in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "key int, frame long, score double, real boolean")
    out = O.threshold_sweep(df, "key", "frame", "score", "real", (0.2, 0.5))
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in out.collect()}
    for t in (0.2, 0.5):
        tp = fp = fn = 0
        for k in range(20):
            a, b = (cuts([r[1] for r in rows if r[0] == k and not flag(r)]) for flag in (lambda r: r[3], lambda r: r[2] > t))
            i = j = hit = 0
            while i < len(a) and j < len(b):
                late, early = b[j][0] > a[i][1], b[j][1] < a[i][0]
                hit, i, j = hit + (not late and not early), i + (not early), j + (not late)
            tp, fp, fn = tp + hit, fp + len(b) - hit, fn + len(a) - hit
        assert got[t] == (tp, fp, fn)


def cuts(off):
    """Widened transitions between the stretches of the frames ``off``."""
    return [(x - 0.5, y + 0.5) for x, y in zip(off, off[1:]) if y > x + 1]
