"""Benchmark decontamination (operator 9): CGK embedding and bit-sampling LSH.

A benchmark item of n words leaks into a document that has a run of words within
``EDIT_PERCENT`` % of n word edits of it.

1. Windows.  A run within k edits of an item shares at least n - q + 1 - k q of its
   q-word grams, so only word positions with that many item grams among the words
   that follow start a window; none of the others can be a leak.
2. Embedding.  Random walks map the item-sized window at each such
   position to sequences of words: a walk emits the current word and a random bit
   of (step, word) decides whether it moves on.  Walks over similar texts fall
   into step again, so a small edit distance becomes a small Hamming distance.
3. LSH.  Several times per walk, a few sampled places of the walk form a key; windows
   that share a key with an item are candidates.  Walks drift apart over long texts, so
   ``SETTINGS`` has more walks and shorter keys for longer items: each row was chosen to
   reach a recall of ``TARGET`` at the full edit limit (measured in ``tests/llm``).
4. Every candidate is verified by exact edit distance (bit-parallel, words as
   symbols, the end of the run free).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.

Scale: one Arrow-batched projection of the text.  The benchmark is the stated
query set: it is read in blocks of at most ``BLOCK_ITEMS`` items, one pass each.

Edge cases: null or blank text and items without words match nothing; repeated
items are all reported; a null item_id is reported as null; an empty benchmark
leaves every document clean; an empty table gives an empty result; very long texts are
searched whole; an earlier column of the result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, MARKS, chunks, gram_hashes, mix, text_bytes, whole, word_hashes

EDIT_PERCENT = 25
GRAM = 3
TARGET = 0.9
SETTINGS = ((0, 8, 6, 3), (48, 12, 8, 3), (96, 16, 8, 2), (240, 24, 8, 2))      # from a size class on: walks, tables a walk, places a key
BLOCK_ITEMS = 20_000
WINDOWS_AT_ONCE = 1 << 14
SEED = np.uint64(0x2545F4914F6CDD1D)


def words_of(texts: pa.Array):
    """(word hashes, first word of each text) of a small string column."""
    data, offs = text_bytes(texts)
    h, _, _, first = word_hashes(LOWER[data[offs[0]:offs[-1]]], offs - offs[0], MARKS)
    return h, first


def _walk(h: np.ndarray, at: np.ndarray, stop: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """Emitted words [window, step] of the walk from each ``at``; beyond ``stop`` there is the word 0."""
    padded = np.r_[h, np.uint64(0)]
    out = np.zeros((len(at), steps), np.uint64)
    pos = at.copy()
    for t in range(steps):
        x = np.where(pos < stop, padded[np.minimum(pos, len(h))], np.uint64(0))
        out[:, t] = x
        salt = (int(SEED) * (walk * 4096 + t + 1)) % (1 << 64)
        pos = pos + (mix(x ^ np.uint64(salt)) >> np.uint64(63)).astype(np.int64)
    return out


def settings(size: int) -> tuple[int, int, int]:
    """(walks, tables a walk, places a key) of a size class."""
    return next(s[1:] for s in reversed(SETTINGS) if size >= s[0])


def _places(size: int, walk: int, table: int, bits: int) -> np.ndarray:
    """The sampled steps for items of a size class."""
    rng = np.random.default_rng([size, walk, table])
    return np.sort(rng.choice(max(bits, 2 * size), bits, replace=False))


def _key(emitted: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(emitted), np.uint64)
    for i, p in enumerate(places):
        out += mix(emitted[:, p] + np.uint64(i + 1))
    return mix(out)


def size_class(n: int) -> int:
    """Items share tables by size, rounded down to a power of 1.3."""
    c = 1
    while (m := max(c + 1, int(c * 1.3))) <= n:
        c = m
    return c


class Items:
    """A block of benchmark items, ready to look windows up."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, first = words_of(pa.array([t or "" for t in texts], pa.string()))
        self.items = [(i, h[a:b]) for i, a, b in zip(ids, first[:-1], first[1:]) if b > a]
        self.edits = [len(w) * EDIT_PERCENT // 100 for _, w in self.items]
        # grams as long as the least that any item of the group keeps untouched
        self.groups: dict[int, list[int]] = {}
        for i, (_, w) in enumerate(self.items):
            q = min(GRAM, -(-(len(w) - self.edits[i]) // (self.edits[i] + 1)))
            self.groups.setdefault(q, []).append(i)
        self.grams, self.least, self.reach = {}, {}, {}
        for q, members in self.groups.items():
            self.grams[q] = np.unique(np.concatenate([gram_hashes(self.items[i][1], q) for i in members]))
            self.least[q] = max(1, min(len(self.items[i][1]) - q + 1 - self.edits[i] * q for i in members))
            self.reach[q] = max(len(self.items[i][1]) + self.edits[i] for i in members)
        self.classes: dict[int, list[int]] = {}
        for i, (_, w) in enumerate(self.items):
            self.classes.setdefault(size_class(len(w)), []).append(i)
        self.steps = max([max(2 * c, settings(c)[2]) for c in self.classes] + [1])
        self.tables = []           # (walk, places, sorted keys, item of each)
        for walk in range(max([settings(c)[0] for c in self.classes], default=0)):
            for c, members in self.classes.items():
                n_walks, n_tables, bits = settings(c)
                if walk >= n_walks:
                    continue
                lens = np.array([len(self.items[i][1]) for i in members])
                flat = np.concatenate([self.items[i][1] for i in members])
                at = np.r_[0, np.cumsum(lens)[:-1]]
                em = _walk(flat, at, at + lens, max(2 * c, bits), walk)
                for t in range(n_tables):
                    places = _places(c, walk, t, bits)
                    k = _key(em, places)
                    o = np.argsort(k, kind="stable")
                    self.tables.append((walk, places, k[o], np.array(members)[o]))

    def starts(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Word positions that may start a leak (see 1. above)."""
        ok = np.zeros(len(h), bool)
        for q, grams in self.grams.items():
            g = gram_hashes(h, q)
            if not len(g):
                continue
            hit = np.isin(g, grams) & whole(first, q, len(g))
            c = np.r_[0, np.cumsum(hit)]
            end = np.minimum(np.repeat(first[1:], np.diff(first))[:len(g)], np.arange(len(g)) + self.reach[q])
            ok[:len(g)] |= c[np.minimum(end, len(g))] - c[:len(g)] >= self.least[q]
        return np.flatnonzero(ok)

    def candidates(self, h: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Distinct (window, item) pairs that share an LSH key."""
        pairs, last, em = [np.zeros(0, np.int64)], -1, None
        for walk, places, keys, members in self.tables:
            if walk != last:
                em, last = _walk(h, at, stop, self.steps, walk), walk
            k = _key(em, places)
            lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
            w = np.flatnonzero(lo < hi)
            n = hi[w] - lo[w]
            which = np.repeat(lo[w] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(w) else w
            pairs.append(np.repeat(w, n) * len(self.items) + members[which] if len(w) else w)
        return np.unique(np.concatenate(pairs))

    def leaks(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item number, first word, words, edits): the best run of each item in each document."""
        best: dict[tuple[int, int], tuple] = {}
        starts = self.starts(h, first)
        for i in range(0, len(starts), WINDOWS_AT_ONCE):
            at = starts[i:i + WINDOWS_AT_ONCE]
            doc = np.searchsorted(first, at, "right") - 1
            stop = first[doc + 1]
            for p in self.candidates(h, at, stop).tolist():
                w, item = divmod(p, len(self.items))
                a, k = int(at[w]), self.edits[item]
                word = self.items[item][1]
                known = best.get((int(doc[w]), item))
                if known and known[0] == 0:
                    continue
                got = edit_distance(word, h[a:min(int(stop[w]), a + len(word) + k)], k)
                if got and (known is None or got[0] < known[0]):
                    best[int(doc[w]), item] = (got[0], a - int(first[doc[w]]), got[1])
        return [(d, item, a, n, e) for (d, item), (e, a, n) in sorted(best.items())]


def edit_distance(item: np.ndarray, run: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, words of the run): least distance of the item to a beginning of ``run``; None above ``most``."""
    n = len(item)
    eq: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        eq[x] = eq.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best = (n, 0)
    for j, x in enumerate(run.tolist(), 1):      # Myers' bit vectors, the run's begin fixed
        e = eq.get(x, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= most else None


def item_blocks(benchmark: DataFrame) -> list[Items]:
    """The benchmark in blocks of at most BLOCK_ITEMS items."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    out = []
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        out.append(Items([r[0] for r in part], [r[1] for r in part]))
    return out


SPANS = "array<struct<item_id:long,first_word:long,n_words:long,edits:long>>"


def leaked(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """All columns of ``docs`` plus ``column``: the best run of each leaked item."""
    kind = T._parse_datatype_string(SPANS)
    out = docs.drop(column).withColumn(column, F.lit(None).cast(kind))
    schema = out.schema
    for items in item_blocks(benchmark):
        def run(batches, items=items):
            for b in batches:
                found: list[list] = [x or [] for x in b.column(b.num_columns - 1).to_pylist()]
                if items.items:
                    data, offs = text_bytes(b.column(b.schema.names.index("text")).cast(pa.string()))
                    for i, j in chunks(offs, most=1 << 30):
                        h, _, _, first = word_hashes(LOWER[data[offs[i]:offs[j]]], offs[i:j + 1] - offs[i], MARKS)
                        for d, item, a, n, e in items.leaks(h, first):
                            found[i + d].append({"item_id": items.items[item][0], "first_word": a, "n_words": n, "edits": e})
                spans = pa.array(found, pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "first_word", "n_words", "edits")])))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], spans], b.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, columns as they were."""
    return leaked(docs, benchmark, "__leaks").filter(F.size("__leaks") == 0).drop("__leaks")
