"""Folds fitted side by side give what each fold gives alone; folds without both classes are left out."""

import datetime as dt
import random

import pytest

from roadpulse.operators import models as MD


def _frame(spark, n, closed):
    rng = random.Random(5)
    cols = MD.CLOSURE_FEATURES
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), int(closed(i, rng)), *[float(rng.randrange(6)) for _ in cols]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, start_datetime timestamp_ntz, road_closure_binary int, " + ", ".join(f"{c} double" for c in cols))


def test_folds_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(MD, "GBT_ITER", 3)
    frame = _frame(spark, 240, lambda i, rng: rng.random() < 0.4)
    got = {r.fold: (r.roc_auc, r.pr_auc) for r in MD.walk_forward(frame, 3).collect()}
    monkeypatch.setattr(MD, "at_once", lambda spark, jobs: [j() for j in jobs])
    alone = {r.fold: (r.roc_auc, r.pr_auc) for r in MD.walk_forward(frame, 3).collect()}
    assert set(got) == {0, 1, 2} and all(got[f] == pytest.approx(alone[f]) for f in got)


def test_folds_without_both_classes_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(MD, "GBT_ITER", 2)
    # no closure in the first half: nothing to learn from for the early folds, and one class in the last test rows
    frame = _frame(spark, 200, lambda i, rng: 100 <= i < 150 and i % 2)
    assert [r.fold for r in MD.walk_forward(frame, 3).collect()] == []
    some = _frame(spark, 200, lambda i, rng: i < 120 and i % 3 == 0)
    assert [r.fold for r in MD.walk_forward(some, 3).collect()] == [0, 1]


def test_results_come_in_the_order_of_the_jobs(spark):
    assert MD.at_once(spark, [lambda i=i: spark.range(i).count() for i in range(6)]) == list(range(6))
    assert MD.at_once(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        MD.at_once(spark, [lambda: 1 / 0])
