"""Substring deduplication over word windows (operator 4): difference-cover anchors.

Every 13-word window that also starts in a document with a smaller doc_id is
removed.  The positions of a document whose word index modulo ``PERIOD`` lies in
a difference cover are anchored by a hash of ``PERIOD`` words: two equal windows
at any two positions share an aligned anchor.  Anchors that occur only once can
not belong to a repeated window; around the others the windows are extended to
13 words, and the least doc_id of each extended window decides.

Scale: see ``packed``; a common passage counts once per part, windows are judged
by sorted 64-bit hashes, the text is shuffled once.

Edge cases: null text has no words; a null doc_id counts as the largest, so it
removes nothing from others; rows with equal doc_id do not remove each other's
windows; repeated rows are each returned; an empty table gives an empty result.
Very long texts are searched whole, one at a time beyond a chunk of about 1 MB; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import among, chunks, column, gram_hashes, group_min, long_column, text_bytes, whole, word_hashes
from .common import shuffle_partitions
from .packed import answer, arrays_of, ask, count_answer, count_request, counts_of, dealt, key_codes, meet, message, part_of

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)          # every difference modulo 7 is a difference of two of these
NULL_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _anchors(h: np.ndarray, first: np.ndarray):
    """(hashes of all PERIOD-word runs, mask of those at cover positions inside one document)."""
    k = WINDOW - PERIOD + 1
    g = gram_hashes(h, k)
    inside = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    return g, cover[inside[:len(g)] % PERIOD] & whole(first, k, len(g))


def _documents(table: pa.Table):
    """Chunks of the part: (doc ids, bytes, offsets, word hashes, starts, ends, first words)."""
    ids = long_column(table, "doc_id", NULL_ID)
    data, offs = text_bytes(table.column("text"))
    for i, j in chunks(offs, most=1 << 30):
        d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        yield (ids[i:j], d, o, *word_hashes(d, o))


def _owner(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(ids, np.diff(first))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words."""
    nb = shuffle_partitions(docs.sparkSession)

    def anchor_codes(table):
        got = []
        for _, _, _, h, _, _, first in _documents(table):
            g, at = _anchors(h, first)
            got.append(key_codes(g[at], nb))
        return np.concatenate(got)

    def ask_anchors(table):
        return count_request(part_of(table), anchor_codes(table), nb)

    def ask_windows(table, answers):
        """The windows around anchors that occur again: hash and least doc_id."""
        if not len(table):
            return message(0, [])
        held = []
        for ids, _, _, h, _, _, first in _documents(table):
            g, at = _anchors(h, first)
            held.append((ids, h, first, np.flatnonzero(at), key_codes(g[at], nb)))
        codes, counts = counts_of(answers, np.concatenate([x[-1] for x in held]), nb)
        again = codes[counts > 1]
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for ids, h, first, hit, code in held:
            w = gram_hashes(h, WINDOW)
            if not len(w):
                continue
            hit = hit[among(code, again)]
            near = np.zeros(len(h) + PERIOD + 1, np.int32)   # windows that start 0 .. PERIOD-1 words before a hit
            np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            ok = (np.cumsum(near)[:len(w)] > 0) & whole(first, WINDOW, len(w))
            keys.append(w[ok])
            owners.append(_owner(ids, first)[:len(w)][ok])
        k, low = group_min(np.concatenate(keys), np.concatenate(owners))
        b = (k % np.uint64(nb)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        bounds = np.searchsorted(b[order], np.arange(nb + 1))
        return message(part_of(table), [
            (i, k[o].tobytes(), low[o].tobytes()) for i in range(nb) if len(o := order[bounds[i]:bounds[i + 1]])])

    def answer_windows(table):
        """To each part, the windows that start in a smaller document elsewhere."""
        keys, low = arrays_of(table, "keys", np.uint64), arrays_of(table, "extra", np.int64)
        u, m = group_min(np.concatenate(keys), np.concatenate(low))
        rows = []
        for k, x in zip(keys, low):
            least = m[np.searchsorted(u, k)]
            sel = least < x
            rows.append((k[sel].tobytes(), least[sel].tobytes()))
        return pa.table({"part": column(table, "part"), "bucket": column(table, "bucket"),
                         "keys": pa.array([r[0] for r in rows], pa.binary()),
                         "extra": pa.array([r[1] for r in rows], pa.binary())})

    def cut(table, answers):
        ids_null = column(table, "doc_id").is_null().to_numpy(zero_copy_only=False)
        keys, owners, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for ids, d, o, h, s, e, first in _documents(table):
            w = gram_hashes(h, WINDOW)
            ok = np.flatnonzero(whole(first, WINDOW, len(w)))
            keys.append(w[ok])
            owners.append(_owner(ids, first)[ok])
            held.append((ids, d, o, s, e, first, ok, keys[-1], owners[-1]))
        if len(answers):
            keys.append(np.concatenate(arrays_of(answers, "keys", np.uint64)))
            owners.append(np.concatenate(arrays_of(answers, "extra", np.int64)))
        known, least = group_min(np.concatenate(keys), np.concatenate(owners))
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for ids, d, o, s, e, first, ok, w, owner in held:
            flag = np.zeros(len(s) + 1, np.int64)
            if len(ok):
                flag[ok] = least[np.searchsorted(known, w)] < owner
            c = np.cumsum(flag[:-1])
            gone = c > 0
            gone[WINDOW:] = c[WINDOW:] > c[:-WINDOW]
            kept = ~gone
            n_gone = np.add.reduceat(np.r_[gone, False], first[:-1].clip(max=len(gone))) if len(first) > 1 else []
            n_all = np.diff(first)
            n_gone = np.where(n_all > 0, n_gone, 0)
            mask = np.zeros(len(d) + 1, np.int8)
            ks, ke = s[kept], e[kept]
            np.add.at(mask, ks, 1)
            np.add.at(mask, ke, -1)
            take = np.cumsum(mask[:-1]) > 0
            doc = np.repeat(np.arange(len(ids)), n_all)[kept]
            sep = ke[:-1][doc[1:] == doc[:-1]]      # one space after each kept word but a document's last
            d = d.copy()
            d[sep] = 0x20
            take[sep] = True
            bounds = np.r_[0, np.cumsum(take)][o]
            flat = memoryview(d[take].tobytes())
            out["doc_id"].append(ids)
            out["n_words"].append(n_all)
            out["n_removed"].append(n_gone)
            parts = [flat[bounds[i]:bounds[i + 1]] for i in range(len(ids))]
            out["kept_sha256"] += [hashlib.sha256(p).hexdigest() for p in parts]
            out["kept"] += [bytes(p).decode() if keep_text else None for p in parts]
        cat = {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("doc_id", "n_words", "n_removed")}
        return pa.table({"doc_id": pa.array(cat["doc_id"], pa.int64(), mask=ids_null),
                         "n_words": pa.array(cat["n_words"], pa.int64()), "n_removed": pa.array(cat["n_removed"], pa.int64()),
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.string())})

    parts = dealt(docs)
    repeated = answer(ask(parts, ask_anchors), count_answer)
    windows = meet(parts, repeated, ask_windows, "part int, bucket int, keys binary, extra binary")
    return meet(parts, answer(windows, answer_windows), cut, RESULT)
