"""Dedup operators against brute force on the small table with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.conftest import make
from roadpulse.llm import anchors, jaccard_join, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def covered(n, starts, width):
    gone = bytearray(n)
    for a in starts:
        gone[a:a + width] = b"\1" * width
    return gone


def test_bytes_against_brute_force(docs):
    rows, least, want = rows_of(docs), {}, Counter()
    for i, t in rows:
        b, i = t.encode(), LAST if i is None else i
        for a in range(len(b) - 49):
            k = b[a:a + 50]
            least[k] = min(least.get(k, i), i)
    for i, t in rows:
        b = t.encode()
        gone = covered(len(b), [a for a in range(len(b) - 49) if least[b[a:a + 50]] < (LAST if i is None else i)], 50)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
                  for r in suffix.remove_repeats(docs, keep_bytes=True).collect())
    assert got == want


def test_words_against_brute_force(docs):
    rows, least, want = rows_of(docs), {}, Counter()
    for i, t in rows:
        w = WORD.findall(t)
        for a in range(len(w) - 12):
            k = tuple(w[a:a + 13])
            least[k] = min(least.get(k, LAST), LAST if i is None else i)
    for i, t in rows:
        w = WORD.findall(t)
        gone = covered(len(w), [a for a in range(len(w) - 12) if least[tuple(w[a:a + 13])] < (LAST if i is None else i)], 13)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept)
                  for r in anchors.remove_repeats(docs, keep_text=True).collect())
    assert got == want


def brute_components(rows):
    sets, ids = [], [r[0] for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, t in rows:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                up[max(find(a), find(b))] = min(find(a), find(b))
    name = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            name[find(i)] = min(name.get(find(i), LAST), ids[i])
    return Counter((ids[i], len(sets[i]), name.get(find(i))) for i in range(len(rows)))


def test_jaccard_against_brute_force(docs):
    got = jaccard_join.similar_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows_of(docs))


@pytest.mark.parametrize("block", [400, 7])
def test_jaccard_near_copies(spark, monkeypatch, block):
    """A large group of near-copies, star-shaped around its original, in one or many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd, rows = random.Random(3), []
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        rows.append((i * 7 % 61, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{rnd.randrange(5)}" for _ in range(9))) for i in range(20)]
    got = jaccard_join.similar_components(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_keep_one_of_each_group(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 903 in ids and 904 not in ids and {900, 901, 902, None} <= set(ids)


def test_empty_tables(empty):
    assert suffix.remove_repeats(empty).count() == 0
    assert anchors.remove_repeats(empty).count() == 0
    assert jaccard_join.similar_components(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(2, 300))
        a = rng.integers(1, 2 + trial % 6, n).astype(np.uint8)
        a[rng.integers(0, n, trial % 7)] = 0
        a[-1] = 0
        sa = suffix.suffix_array(a)
        full = [bytes(np.r_[a, np.zeros(50, np.uint8)][i:i + 50]) for i in sa]
        assert sorted(sa.tolist()) == list(range(n))
        cut = [x.split(b"\0")[0] for x in full]
        assert cut == sorted(cut)
        lcp = suffix.common_prefixes(a, sa)
        for x, y, k in zip(full, full[1:], lcp[1:]):
            assert k == next((j for j in range(50) if x[j] != y[j]), 50)


def test_cover_aligns_every_shift():
    for shift in range(anchors.PERIOD):
        assert any((a + shift) % anchors.PERIOD in anchors.COVER for a in anchors.COVER)
