"""Ranked lexical search (operator 11): exact top documents per item by dual-tree search.

A score is the inner product of an item's vector (how often it holds a term) and a
document's vector (the term's weight times its saturated frequency), in integers.

1. One pass over the texts keeps of each document its number of terms and the
   frequencies of those that some item holds (a written table); document counts and
   lengths are sums over it.
2. Two hierarchies: one over the items, one over each block of documents of a task.
   Both part their members into two clusters again and again, and every node holds
   the greatest value of each coordinate below it.  As no coordinate is negative,
   the inner product of two nodes' maxima bounds every score between them.
3. A pair of nodes is dropped, with all its documents and items, where its bound is
   below the weakest k-th score known for the node's items; otherwise both are
   parted.  At the leaves the scores are computed.  Equal scores are never dropped.
4. The k-th scores start from the search of a bounded sample of documents
   (``SEED_DOCUMENTS``, by a hash): any k documents' scores bound the true k-th score from
   below, so the sample only saves work; every document is searched.  A task's own
   results raise them; the tasks' lists are merged by a ranking window.

The items are the stated query set: they are read in blocks of about ``BLOCK_ITEMS`` items
and ``BLOCK_BYTES`` of text, one pass over the documents each, and only a block is in the
driver or sent to tasks.

Terms are told apart by 64-bit hashes.

Edge cases: null and blank texts have no terms and no rank; items without terms have
no rows; repeated items (also of one item_id) are ranked each on its own; repeated
documents hold a rank each; a null doc_id comes last among equal scores; very long texts
are hashed whole, a chunk of about 1 MB of shorter ones at a time; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, MARKS, chunks, long_column, text_bytes, word_hashes
from .common import shuffle_partitions, staged

TOP = 10
BLOCK_ITEMS = 500
BLOCK_BYTES = 512 << 10
SEED_DOCUMENTS = 20_000
LEAF_DOCUMENTS, LEAF_ITEMS = 16, 4
TREE_CELLS = 1 << 23            # coordinate maxima of one tree of documents
NO_ID = np.iinfo(np.int64).max

VECTORS = "doc_id long, n long, terms binary, tf binary"
FOUND = "item int, doc_id long, score long"


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes of all texts, first term of each text with the total at the end)."""
    data, offs = text_bytes(texts)
    h, _, _, first = word_hashes(LOWER[data[offs[0]:offs[-1]]], offs - offs[0], MARKS)
    return h, first


class Items:
    """A block of items: their terms (ascending hashes) and, per item, places of its terms and how often it holds them."""

    def __init__(self, texts: list[str | None]):
        h, first = term_hashes(pa.array([t or "" for t in texts], pa.string()))
        self.terms, place = np.unique(h, return_inverse=True)
        rows = np.repeat(np.arange(len(texts)), np.diff(first))
        cell, self.times = np.unique(rows * max(1, len(self.terms)) + place, return_counts=True)
        self.place = cell % max(1, len(self.terms))
        self.first = np.searchsorted(cell, np.arange(len(texts) + 1) * max(1, len(self.terms)))

    def __len__(self) -> int:
        return len(self.first) - 1


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): every document's number of terms, places of those in ``terms``, and their frequencies."""
    def run(batches):
        for b in batches:
            n, at, tf = [], [], []
            data, offs = text_bytes(b.column(1))
            for i, j in chunks(offs):
                h, _, _, first = word_hashes(LOWER[data[offs[i]:offs[j]]], offs[i:j + 1] - offs[i], MARKS)
                place = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
                known = np.flatnonzero(terms[place] == h) if len(terms) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, known, "right") - 1
                cell, count = np.unique(doc * max(1, len(terms)) + place[known], return_counts=True)
                cut = np.searchsorted(cell, np.arange(j - i + 1) * max(1, len(terms)))
                where, count = (cell % max(1, len(terms))).astype(np.uint32), count.astype(np.uint32)
                n += np.diff(first).tolist()
                at += [where[p:q].tobytes() for p, q in zip(cut, cut[1:])]
                tf += [count[p:q].tobytes() for p, q in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())],
                                             ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, VECTORS)


def document_frequency(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each of the block's terms: summed in the tasks, then by term."""
    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            places = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
            total += np.bincount(places, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


# -- hierarchies ---------------------------------------------------------------------------

class Rows:
    """Sparse rows: row r has the columns ``col[first[r]:first[r + 1]]`` with the values ``val``."""

    def __init__(self, first: np.ndarray, col: np.ndarray, val: np.ndarray, width: int):
        self.first, self.col, self.val, self.width = first, col, val, width

    def dense(self, rows: np.ndarray) -> np.ndarray:
        n = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.first[rows] - np.r_[0, ends[:-1]], n) + np.arange(ends[-1] if len(n) else 0)
        out = np.zeros((len(rows), self.width), self.val.dtype)
        out[np.repeat(np.arange(len(rows)), n), self.col[at]] = self.val[at]
        return out

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """The rows in the order of two clusters, and the size of the first.

        Two rows far apart, then the means of those nearer to either, twice; the cut goes
        between the clusters unless one has less than an eighth of the rows.
        """
        n = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.first[rows] - np.r_[0, ends[:-1]], n) + np.arange(ends[-1])
        which, col, v = np.repeat(np.arange(len(rows)), n), self.col[at], self.val[at].astype(np.float64)
        v /= np.sqrt(np.bincount(which, v * v, len(rows)))[which]

        def along(direction):
            return np.bincount(which, v * direction[col], len(rows))

        def mean(members):
            return np.bincount(col, v * members[which], self.width) / max(1, members.sum())

        far = mean(np.arange(len(rows)) == np.argmin(along(mean(np.ones(len(rows))))))
        side = along(far) - along(mean(np.arange(len(rows)) == np.argmin(along(far))))
        for _ in range(2):
            side = along(mean(side > 0) - mean(side <= 0))
        order = np.argsort(side, kind="stable")
        cut = int((side <= 0).sum())
        return rows[order], cut if len(rows) <= 8 * min(cut, len(rows) - cut) else len(rows) // 2


class Hierarchy:
    """A binary tree over rows: node i holds the rows ``order[begin[i]:end[i]]`` and their coordinate maxima."""

    def __init__(self, rows: Rows, members: np.ndarray, leaf: int):
        self.order, self.begin, self.end, self.left, self.right = members.copy(), [], [], [], []
        maxima: list = []

        def build(a: int, z: int) -> int:
            i = len(self.begin)
            self.begin.append(a)
            self.end.append(z)
            self.left.append(-1)
            self.right.append(-1)
            maxima.append(None)
            if z - a <= leaf:
                maxima[i] = rows.dense(self.order[a:z]).max(0)
                return i
            self.order[a:z], first = rows.split(self.order[a:z])
            self.left[i], self.right[i] = build(a, a + first), build(a + first, z)
            maxima[i] = np.maximum(maxima[self.left[i]], maxima[self.right[i]])
            return i

        if len(members):
            build(0, len(members))
        self.maxima = np.array(maxima) if maxima else np.zeros((0, rows.width), rows.val.dtype)


class Search:
    """The items' hierarchy and the best documents found so far for each item."""

    def __init__(self, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int):
        most = int(items.times.sum()) * int(weight.max(initial=0)) * 10**6
        self.kind = np.float64 if most < 1 << 53 else np.int64      # sums of integers that doubles hold exactly
        self.weight, self.n_docs, self.n_terms, self.top = weight, n_docs, n_terms, top
        self.rows = Rows(items.first, items.place, items.times.astype(self.kind), max(1, len(items.terms)))
        self.tree = Hierarchy(self.rows, np.flatnonzero(np.diff(items.first) > 0), LEAF_ITEMS)
        self.floor = floor.copy()                                    # of each item, in its own order
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(items))]    # (-score, doc_id)
        self.ahead: dict[int, np.ndarray] = {}

    def coordinates(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The documents' values of terms: n, term, tf of each cell."""
        m = 25 + 75 * n * self.n_docs // max(1, self.n_terms)
        return self.weight[term] * (10**9 * tf // (1000 * tf + 8 * m))

    def add(self, doc_ids: np.ndarray, n: np.ndarray, terms: list[bytes], tf: list[bytes]) -> None:
        """Search a block of documents."""
        col = np.frombuffer(b"".join(terms), np.uint32).astype(np.int64)
        first = np.r_[0, np.cumsum([len(t) // 4 for t in terms])]
        tf = np.frombuffer(b"".join(tf), np.uint32).astype(np.int64)
        val = self.coordinates(np.repeat(n, np.diff(first)), col, tf).astype(self.kind)
        docs = Rows(first, col, val, self.rows.width)
        tree = Hierarchy(docs, np.flatnonzero(np.diff(first) > 0), LEAF_DOCUMENTS)
        if len(tree.begin) and len(self.tree.begin):
            self.visit(docs, tree, doc_ids, 0, np.array([0]))

    def weakest(self, nodes: np.ndarray) -> np.ndarray:
        """The least k-th score of each node's items."""
        low = self.floor[self.tree.order]
        return np.array([low[self.tree.begin[i]:self.tree.end[i]].min() for i in nodes])

    def parted(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes' children; leaves stay."""
        return np.array([c for i in nodes for c in ([i] if self.tree.left[i] < 0 else [self.tree.left[i], self.tree.right[i]])], np.int64)

    def visit(self, docs: Rows, tree: Hierarchy, doc_ids: np.ndarray, node: int, against: np.ndarray) -> None:
        """Search a node of documents against nodes of items; pairs that cannot hold a result are dropped whole."""
        against = against[self.tree.maxima[against] @ tree.maxima[node] >= self.weakest(against)]
        if not len(against):
            return
        if tree.left[node] >= 0:
            nodes = self.parted(against)
            bounds = [(self.tree.maxima[nodes] @ tree.maxima[c]).sum() for c in (tree.left[node], tree.right[node])]
            for c in sorted((tree.left[node], tree.right[node]), key=lambda c: -bounds[c == tree.right[node]]):
                self.visit(docs, tree, doc_ids, c, nodes)
            return
        while any(self.tree.left[i] >= 0 for i in against):
            against = self.parted(against)
            against = against[self.tree.maxima[against] @ tree.maxima[node] >= self.weakest(against)]
        members = tree.order[tree.begin[node]:tree.end[node]]
        here = docs.dense(members)
        for i in against:
            own = self.tree.order[self.tree.begin[i]:self.tree.end[i]]
            scores = here @ self.rows.dense(own).T
            for item, s in zip(own.tolist(), scores.T):
                good = np.flatnonzero(s >= self.floor[item])
                if len(good):
                    self.keep(item, s[good], doc_ids[members[good]])

    def keep(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = sorted(self.best[item] + [(-int(s), int(d)) for s, d in zip(scores, ids)])[:self.top]
        self.best[item] = best
        if len(best) == self.top:
            self.floor[item] = max(self.floor[item], -best[-1][0])

    def found(self) -> pa.RecordBatch:
        rows = [(i, None if d == NO_ID else d, -s) for i, best in enumerate(self.best) for s, d in best]
        cols = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))],
                                          ["item", "doc_id", "score"])


def searched(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task, without those below the items' floors."""
    # trees of so many documents that the maxima of their nodes fit TREE_CELLS
    most = max(LEAF_DOCUMENTS, TREE_CELLS // (4 * max(1, len(items.terms))) * LEAF_DOCUMENTS)

    def run(batches):
        search = Search(items, weight, n_docs, n_terms, floor, top)
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            search.add(long_column(t, "doc_id", NO_ID), long_column(t, "n", 0), t.column("terms").to_pylist(), t.column("tf").to_pylist())
            held.clear()

        size = 0
        for b in batches:
            for i in range(0, len(b), most):
                part = b.slice(i, most)
                if size + len(part) > most:
                    flush()
                    size = 0
                held.append(part)
                size += len(part)
        if held:
            flush()
        yield search.found()

    return found.mapInArrow(run, FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def sampled(found: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most, by a hash of the row's place."""
    n = max(1, found.count())
    return found.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < min(1 << 30, -(-(bound << 30) // n)))


def search_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block; item is the place in the block."""
    found = staged(vectors(docs, items.terms), "vectors")
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(n_docs, document_frequency(found, len(items.terms)))
    floor = np.ones(len(items), np.int64)                   # scores above 0
    seeds = sampled(found, SEED_DOCUMENTS).repartition(shuffle_partitions(docs.sparkSession))
    weakest = ranked(searched(seeds, items, weight, n_docs, n_terms, floor, top), top).filter(F.col("rank") == top)
    for item, score in weakest.select("item", "score").collect():       # a row for each item of the block at most
        floor[item] = score
    return ranked(searched(found, items, weight, n_docs, n_terms, floor, top), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, ties by ascending doc_id."""
    spark = docs.sparkSession
    rows = staged(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    kind = rows.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()
        if part:
            ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {kind}")
            got = search_block(docs, Items([r.text for r in part]), top)
            if blocks > 1:
                got = staged(got, "ranked")
            got = got.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")     # a block's items
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
