"""Operator 11 against a plain ranking of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import lexical_search as LS
from roadpulse.llm.queries import QUERIES

from .conftest import make

SF0001 = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, size in own:
            m = 25 + 75 * size * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, k in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_against_plain_ranking(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(QUERIES["op11_lexical_search"](spark, SF0001)) == plain(docs, items)


ITEMS = [(1, "Ünï çödé 漢字 漢字"), (2, None), (3, " .,; "), (4, "the the THE seven words"), (4, "the the THE seven words"), (None, "word x no such term"),
         (6, "a b c d e f g h"), (7, "one two")]


def test_awkward_tables(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    extra = docs.withColumn("item", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("n", F.lit(2))
    assert got(LS.search(extra, items_of(spark, ITEMS))) == plain(rows, ITEMS)
    assert LS.search(empty, items_of(spark, ITEMS)).collect() == []
    assert LS.search(docs, items_of(spark, [])).collect() == []


def test_ties_by_doc_id(spark):
    rows = [(i, "alpha beta gamma" if i % 3 else "delta alpha") for i in range(200, 0, -1)] + [(None, "alpha beta gamma"), (7, "alpha beta gamma")]
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta delta"), (4, "omega")]
    assert got(LS.search(make(spark, rows).repartition(5), items_of(spark, items))) == plain(rows, items)


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(LS, "BLOCK_ITEMS", 3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(LS.search(docs, items_of(spark, ITEMS))) == plain(rows, ITEMS)


@pytest.mark.parametrize("peak", [10, 10**9])
def test_trees_prune_and_stay_exact(peak):
    """Random sparse vectors: the tree search keeps what a full product keeps, and looks at fewer pairs."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    topics = [rng.choice(words, 30, replace=False) for _ in range(20)]
    texts = [" ".join(rng.choice(topics[i % 20], 25)) for i in range(3000)]
    items = LS.Items([" ".join(rng.choice(topics[i % 20], 8)) for i in range(60)])
    weight = np.full(len(items.terms), peak, np.int64)
    import pyarrow as pa
    h, first = LS.term_hashes(pa.array(texts))
    place = np.minimum(np.searchsorted(items.terms, h), len(items.terms) - 1)
    at, tf = [], []
    for a, b in zip(first, first[1:]):
        p = place[a:b][items.terms[place[a:b]] == h[a:b]]
        u, c = np.unique(p, return_counts=True)
        at.append(u.astype(np.uint32).tobytes())
        tf.append(c.astype(np.uint32).tobytes())
    search = LS.Search(items, weight, len(texts), int(first[-1]), np.ones(60, np.int64), 10)
    assert search.kind is (np.float64 if peak == 10 else np.int64)
    full = np.zeros((3000, 60), object)
    n = np.diff(first)
    looked = []
    dense = LS.Rows.dense
    search.add(np.arange(3000), n, at, tf)
    for d in range(3000):
        val = dict(zip(np.frombuffer(at[d], np.uint32).tolist(),
                       search.coordinates(np.full(len(at[d]) // 4, n[d]), np.frombuffer(at[d], np.uint32).astype(np.int64), np.frombuffer(tf[d], np.uint32).astype(np.int64)).tolist()))
        for i in range(60):
            s = slice(items.first[i], items.first[i + 1])
            full[d, i] = sum(int(k) * val.get(int(p), 0) for p, k in zip(items.place[s], items.times[s]))
    for i in range(60):
        want = sorted((-full[d, i], d) for d in range(3000) if full[d, i] > 0)[:10]
        assert search.best[i] == want
    # with the true k-th scores known, most pairs of a leaf and an item are dropped with their nodes
    again = LS.Search(items, weight, len(texts), int(first[-1]), search.floor.copy(), 10)
    LS.Rows.dense = lambda self, rows: (looked.append(len(rows)) if self is again.rows else None) or dense(self, rows)
    try:
        again.add(np.arange(3000), n, at, tf)
    finally:
        LS.Rows.dense = dense
    assert again.best == search.best
    leaves = -(-3000 // LS.LEAF_DOCUMENTS)
    assert 0 < sum(looked) < 60 * leaves / 3
