"""Raking goes on while its error rises, ends where it stands still, and tells what it missed."""

import logging

from pyspark.sql import functions as F

from roadpulse.llm import mixing

# (source, lang, topic, tokens): sparse; the largest relative error rises in an early round and falls to 0 later
SPARSE = [(("0", "3", "0"), 148), (("1", "0", "2"), 107), (("0", "0", "0"), 1), (("1", "0", "0"), 113), (("0", "2", "3"), 13),
          (("0", "2", "0"), 253), (("1", "3", "2"), 28)]
FAR = [(("3", "1", "4"), 16), (("0", "1", "0"), 1), (("3", "1", "1"), 7), (("0", "0", "1"), 718), (("3", "0", "0"), 120),
       (("0", "0", "4"), 658), (("3", "1", "2"), 51)]


def raked(spark, rows, given=None, **kw):
    cells = spark.createDataFrame([(*k, n) for k, n in rows], "m_source string, m_lang string, m_topic string, tokens long")
    goals = {d: mixing.targets(cells, d, (given or {}).get(d)) for d in mixing.DIMS}
    out = mixing.rake(cells, goals, **kw)
    assert out.columns.count("weight") == 1 and set(out.columns) == {*mixing.DIMS, "tokens", "weight"}
    return {tuple(r[d] for d in mixing.DIMS): r.weight for r in out.collect()}, mixing.missed(out, goals), goals


def worst(weights, goals):
    off = 0.0
    for i, d in enumerate(mixing.DIMS):
        for r in goals[d].collect():
            have = sum(w for k, w in weights.items() if k[i] == r[d])
            off = max(off, abs(have - r.target) / r.target)
    return off


def test_a_rising_error_ends_nothing(spark):
    for rows in (SPARSE, FAR):
        w, missed, goals = raked(spark, rows)
        assert worst(w, goals) < mixing.TOLERANCE and missed.count() == 0


def test_rounds_as_joins_give_the_same_weights(spark):
    w, _, goals = raked(spark, SPARSE)
    joined, _, _ = raked(spark, SPARSE, driver_cells=0)
    assert all(abs(w[k] - joined[k]) < 1e-9 for k in w) and set(w) == set(joined)


def test_targets_that_cannot_be_met_are_told(spark, caplog):
    rows = [(("a", "x", "p"), 10), (("b", "y", "p"), 10)]
    with caplog.at_level(logging.WARNING):
        _, missed, _ = raked(spark, rows, {"m_lang": {"x": 0.9, "y": 0.1}})
    got = {(r.dim, r.value) for r in missed.collect()}
    assert got == {("m_source", "a"), ("m_source", "b")} and "m_source=b" in caplog.text


def test_no_cells(spark):
    assert raked(spark, [(("a", "x", "p"), 10)])[0] == {("a", "x", "p"): 1.0}
    empty = spark.createDataFrame([], "m_source string, m_lang string, m_topic string, tokens long")
    assert mixing.rake(empty, {d: mixing.targets(empty, d) for d in mixing.DIMS}).filter(F.col("weight") > 0).count() == 0
