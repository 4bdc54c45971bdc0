"""Decontamination, mixing and the pipeline."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from llm.conftest import make
from roadpulse.llm import decontaminate, mixing

SF = "/root/testdata/sf0.001"


def distance_to_any_run(item, words):
    """Least word edit distance of the item to any run of the words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_recall(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rnd, hosts = random.Random(9), [r.text for r in docs.filter("doc_id < 60").select("text").collect()]
    rows = []
    for r in bench.orderBy("item_id").limit(12).collect():
        for rate in (0.0, 0.1, 0.2):
            w = r.text.split()
            for _ in range(int(len(w) * rate)):
                p = rnd.randrange(len(w))
                w[p:p + rnd.randrange(2)] = [rnd.choice(hosts[0].split())] * rnd.randrange(2)
            h = rnd.choice(hosts).split()[:150]
            p = rnd.randrange(len(h) + 1)
            rows.append((len(rows), " ".join(h[:p] + w + h[p:])))
    rows += [(len(rows) + i, " ".join(h.split()[:150])) for i, h in enumerate(hosts[:15])] + [(500, None), (501, ""), (None, "x y")]
    got = {(r.doc_id, x.item_id) for r in decontaminate.leaked(make(spark, rows), bench).collect() for x in r.leaks}
    items = decontaminate.item_blocks(bench)[0]
    h, first = decontaminate.words_of(pa.array([t or "" for _, t in rows], pa.string()))
    want = {(i, item) for (i, _), a, b in zip(rows, first[:-1], first[1:]) for n, (item, w) in enumerate(items.items)
            if len(np.intersect1d(w, h[a:b])) * 2 > len(set(w.tolist()))
            and distance_to_any_run(w.tolist(), h[a:b].tolist()) <= items.edits[n]}
    assert len(want) >= 30 and got <= want and len(got) >= 0.95 * len(want)


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta eta theta"), (1, None), (2, ""), (3, "omega")],
                                  "item_id long, text string")
    d = make(spark, [(1, "so ALPHA, beta gamma delta epsilon zeta eta theta."), (2, "alpha only"), (3, "the omega"), (4, None)])
    d = d.withColumn("leaks", F.lit("clash"))
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.leaked(d, bench).collect()}
    assert got == {1: [None], 2: [], 3: [3], 4: []}
    assert decontaminate.clean(d, bench).columns == d.columns
    assert decontaminate.leaked(empty, bench).count() == 0
    assert decontaminate.clean(d, bench.limit(0)).count() == 4


def test_edit_distance_to_a_beginning():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(0, 12))]
        row = list(range(len(a) + 1))
        best = row[-1]
        for j, y in enumerate(b, 1):
            new = [j]
            for i, x in enumerate(a, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
            row, best = new, min(best, new[-1])
        got = decontaminate.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), len(a))
        assert got[0] == best


def test_raking_meets_its_marginals(docs):
    goal = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1, "xx": 0.5}
    w = mixing.weights(docs.filter("lang is not null"), lang=goal)
    for dim in mixing.DIMS:
        cells = docs.filter("lang is not null")
        t = mixing.targets(mixing.with_cells(cells).groupBy(*mixing.DIMS).agg(F.sum("m_tokens").alias("tokens")).filter("tokens > 0"),
                           dim, goal if dim == "m_lang" else None)
        off = w.groupBy(dim).agg(F.sum("weight").alias("w")).join(t, dim).agg(F.max(F.abs(F.col("w") - F.col("target")))).first()[0]
        assert off < 0.05, dim
    langs = {r["m_lang"]: r["w"] for r in w.groupBy("m_lang").agg(F.sum("weight").alias("w")).collect()}
    assert abs(langs["de"] / langs["fr"] - 1.5) < 0.1


def test_sampling(docs, empty):
    d = docs.withColumn("weight", F.lit("clash"))
    rows = mixing.assign(d).collect()
    assert len(rows) == d.count()
    total = sum(r.m_tokens for r in rows)
    assert abs(sum(r.m_tokens * r.probability for r in rows) / total - mixing.KEEP) < 0.02
    assert not any(r.sampled for r in rows if r.doc_id in (900, 901, 902, 909))
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.assign(empty).count() == 0


def test_pipeline_stages(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = make(spark, [(3000, "we saw " + bench + " there"), (3001, "so here my password = correcthorsebattery is written and read by all of us in the house")])
    d = docs.union(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, d, SF), f"test-{name}")
        assert out.columns == docs.columns
        d = out
    ids = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert 900 not in ids
    assert 3000 not in ids
    assert 904 not in ids
    assert "correcthorse" not in ids[3001]
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert {r.doc_id for r in last.collect()} <= set(ids)
    assert corpus_pipeline.run(spark, SF).count() > 50
