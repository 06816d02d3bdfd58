import math
import random

from vellumine.llm import topn

SCHEMA = "pred_id long, paper_id string, pos int, label string, prob double, scored_at timestamp, sentence string, rank int"


def _brute(rows, n):
    last = {}
    for r in rows:
        if r[0] is None:
            continue
        k = (r[5] is not None, r[5], r[4] is not None, r[4] if r[4] is not None and not math.isnan(r[4]) else (2.0 if r[4] is not None else -1))
        if r[0] not in last or k > last[r[0]][0]:
            last[r[0]] = (k, r)
    groups = {}
    for _, r in last.values():
        if r[1] is None or r[3] is None or r[4] is None or math.isnan(r[4]) or not 0 <= r[4] <= 1:
            continue
        label = r[3].split("_")[0]
        groups.setdefault((r[1], label[:1].upper() + label[1:].lower()), []).append(r)
    out = []
    for g in groups.values():
        out += [r[0] for r in sorted(g, key=lambda r: (-r[4], r[2] if r[2] is not None else 1 << 31, r[0]))[:n]]
    return sorted(out)


def _rows(n, seed):
    from datetime import datetime, timedelta

    rng, t0 = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        paper = rng.choice(["hot"] * 6 + [f"p{k}" for k in range(30)] + [None])
        prob = rng.choice([0.5, 0.5, 0.25, -0.0, 0.0, 1.0, rng.random(), rng.random() * 1e-300, None, float("nan"), 1.5, -0.1])
        out.append((i, paper, rng.choice([0, 1, 2, None]), rng.choice(["Result", "result_label", "METHOD", None, "_x"]), prob, t0 + timedelta(seconds=i), "s", 1))
        if rng.random() < 0.2:
            out.append((*out[-1][:4], rng.random(), t0 + timedelta(days=1, seconds=i), "later", 1))
    return out


def test_equals_brute_force_with_ties_nulls_and_redelivery(spark):
    rows = _rows(900, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n in (1, 5):
        assert sorted(r.pred_id for r in topn.found(topn.top_predictions(df, n)).collect()) == _brute(rows, n)


def test_salted_hot_group_gives_the_same(spark):
    rows = _rows(900, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.pred_id for r in topn.top_predictions(df, 5, unit_rows=40).collect()) == _brute(rows, 5)


def test_more_hot_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topn, "MOST_HOT", 0)
    rows = _rows(900, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.pred_id for r in topn.top_predictions(df, 5, unit_rows=40).collect()) == _brute(rows, 5)


def test_empty_identical_scores_and_large_ids(spark):
    assert topn.top_predictions(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [((1 << 60) + k, "p", 0, "Result", 0.5, None, "s", 1) for k in range(300)] + [(-5, "p", 0, "Result", 0.5, None, "s", 1), (None, "p", 0, "Result", 0.9, None, "s", 1)]
    got = sorted(r.pred_id for r in topn.top_predictions(spark.createDataFrame(rows, SCHEMA), 3).collect())
    assert got == [-5, 1 << 60, (1 << 60) + 1]


def test_sentences_come_back(spark):
    df = spark.createDataFrame(_rows(60, 2), SCHEMA)
    top = topn.top_predictions(df)
    assert topn.with_sentences(df, top).count() == top.count()
