"""Exact substring deduplication over bytes (operator 2): two-stage suffix sorting.

Each byte covered by a 50-byte string that also starts in a document with a
smaller doc_id is removed.

1. Every 50-byte string contains the 20-byte string of least hash in it (its
   minimiser), which depends on the string alone.  Consecutive strings with one
   minimiser form a segment; equal strings always lie in segments of one
   minimiser, so segments are dealt by it.  Minimisers that occur once over the
   corpus cannot belong to a repeated string.
2. The distinct segments of a minimiser bucket form one text, whose suffix array
   is built by two-stage sorting: suffixes smaller than their successor are
   sorted directly (as far as the 50 bytes asked for), the others are induced by
   scanning the buckets of first bytes in order.
3. Common prefixes of adjacent suffixes of at least 50 bytes form groups; the
   least doc_id of each group goes back to the parts that hold the segments.

Scale: a segment that a third of all documents hold is sent once per part; a
bucket is sorted in batches of whole minimisers, so memory follows the batch; the
text is shuffled once (see ``packed``).

Edge cases: null text is empty; texts under 50 bytes lose nothing; a null doc_id
counts as the largest; rows with equal doc_id do not remove each other's bytes;
repeated rows are each returned; an empty table gives an empty result.  Very
long texts are searched whole, one at a time beyond a chunk of about 1 MB; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrays import BYTE, among, chunks, column, group_min, long_column, mix, powers, text_bytes
from .common import shuffle_partitions
from .packed import answer, arrays_of, ask, count_answer, count_request, counts_of, dealt, key_codes, meet, message, part_of

LENGTH = 50
GRAM = 20                      # bytes of a minimiser
BATCH = 1 << 19                # bytes sorted at once, minimisers kept whole
NULL_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


# -- suffix array ---------------------------------------------------------------------

def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of ``text`` in suffix order, compared as far as ``depth`` bytes.

    ``text`` must end with its only smallest byte value repeated as separator
    (0); suffixes that agree in ``depth`` bytes come in any order.
    """
    n = len(text)
    # type B: smaller than its successor; equal bytes take the type of the next position
    differ = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(differ, np.arange(n))
    end = np.r_[differ, n - 1][np.minimum(nxt, len(differ))]
    small = np.zeros(n, bool)
    inner = end < n - 1
    small[inner] = text[end[inner]] < text[end[inner] + 1]
    small[text == 0] = True          # separators are sorted directly
    direct = np.flatnonzero(small)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    keys = np.ascontiguousarray(rows).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    # scan the buckets of first bytes in ascending order, larger-type suffixes first
    first = text[direct]
    start = np.searchsorted(first, np.arange(257))
    pending: dict[int, list[np.ndarray]] = {}
    out = []

    def induce(known: np.ndarray, c: int) -> np.ndarray:
        """Send the larger-type predecessors to their buckets; those of bucket c come back."""
        before = known[known > 0] - 1
        before = before[~small[before]]
        heads = text[before]
        own = before[heads == c]
        before, heads = before[heads != c], heads[heads != c]
        if len(before):
            order = np.argsort(heads, kind="stable")
            hs = heads[order]
            cut = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            for at, piece in zip(cut, np.split(before[order], cut[1:])):
                pending.setdefault(int(hs[at]), []).append(piece)
        return own

    for c in range(256):
        got = pending.pop(c, None)
        known = np.concatenate(got) if got else np.zeros(0, np.int64)
        while len(known):
            out.append(known)
            known = induce(known, c)
        known = direct[start[c]:start[c + 1]]
        while len(known):
            out.append(known)
            known = induce(known, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix length (at most ``depth``) of each suffix with the one before it in the array."""
    padded = np.r_[text, np.zeros(depth + 8, np.uint8)]
    lcp = np.zeros(len(sa), np.int64)
    alive = np.arange(1, len(sa))
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 7, 8), (1, 1))
    for off in range(0, depth, 8):
        a = np.ascontiguousarray(words[sa[alive] + off]).view(np.uint64).ravel()
        b = np.ascontiguousarray(words[sa[alive - 1] + off]).view(np.uint64).ravel()
        diff = a ^ b
        same = diff == 0
        low = diff[~same] & (~diff[~same] + np.uint64(1))      # lowest set bit: the first differing byte
        lcp[alive[~same]] = off + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[same]
    lcp[alive] = depth
    return np.minimum(lcp, depth)


# -- segments -------------------------------------------------------------------------

def segments(data: np.ndarray, offs: np.ndarray):
    """(minimiser, start, end of the last string) of each run of strings with one minimiser."""
    n = len(data)
    n_windows = n - LENGTH + 1
    if n_windows <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    up, down = powers(n)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE[data] * up, out=c[1:])
    h = mix((c[GRAM:] - c[:-GRAM]) * down[:n - GRAM + 1])
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[:len(h) - (span - width)], h[span - width:])
    inside = np.ones(n_windows, bool)          # strings that lie in one document
    for k in range(1, LENGTH):
        at = offs[1:] - k
        inside[at[(at >= 0) & (at < n_windows) & (at >= offs[:-1])]] = False
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (h[1:] == h[:-1]))
    # two documents meet without a cut string between them only where one is empty
    at = offs[:-1]
    at = at[at < n_windows]
    new[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & ~new[1:])
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    return h[s], s, e + LENGTH


def _content(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment's bytes."""
    up, down = powers(len(data))
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE[data] * up, out=c[1:])
    return mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))


def _gather(data: np.ndarray, s: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all segments, one after the other."""
    ends = np.cumsum(length)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - np.r_[0, ends[:-1]] if len(ends) else s, length)]


def _chunked(table: pa.Table):
    """Chunks of a part: (doc ids, bytes, offsets, minimisers, starts, ends of segments)."""
    ids = long_column(table, "doc_id", NULL_ID)
    data, offs = text_bytes(table.column("text"))
    for i, j in chunks(offs, most=1 << 30):
        d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        yield (ids[i:j], d, o, *segments(d, o))


def _distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, least value of each, index of an occurrence of each)."""
    if not len(keys):
        return keys, values, np.zeros(0, np.int64)
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.minimum.reduceat(values[order], at), order[at]


def least_owner(seg: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every 50-byte string of the segments (bytes concatenated in ``seg``), the least owner over equal strings."""
    text = np.zeros(len(seg) + len(length), np.uint8)        # a separator after each segment
    at = np.arange(len(seg)) + np.repeat(np.arange(len(length)), length)
    text[at] = seg + np.uint8(1)                             # UTF-8 has no byte 255
    starts = np.r_[0, np.cumsum(length + 1)[:-1]]
    n_str = length - LENGTH + 1
    order = np.full(len(text), -1, np.int64)                 # position -> number of the string that starts there
    pos = np.arange(n_str.sum()) + np.repeat(starts - np.r_[0, np.cumsum(n_str)[:-1]], n_str)
    order[pos] = np.arange(len(pos))
    sa = suffix_array(text)
    sa = sa[order[sa] >= 0]
    lcp = common_prefixes(text, sa)
    group = np.flatnonzero(lcp < LENGTH)                     # a group begins where the common prefix is short
    which = order[sa]
    own = np.repeat(owner, n_str)
    least = np.minimum.reduceat(own[which], group)
    out = np.empty(len(which), np.int64)
    out[which] = np.repeat(least, np.diff(np.r_[group, len(which)]))
    return out


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    nb = shuffle_partitions(docs.sparkSession)

    def ask_minimisers(table):
        codes = [np.zeros(0, np.uint64)] + [key_codes(h, nb) for *_, h, _, _ in _chunked(table)]
        return count_request(part_of(table), np.concatenate(codes), nb)

    def ask_segments(table, answers):
        """Distinct segments of minimisers that occur again: minimiser, bytes, least doc_id."""
        if not len(table):
            return message(0, [])
        held = [(*x, key_codes(x[3], nb)) for x in _chunked(table)]
        codes, counts = counts_of(answers, np.concatenate([x[-1] for x in held]), nb)
        again = codes[counts > 1]
        seen: list[tuple] = []
        for ids, d, o, h, s, e, code in held:
            sel = among(code, again)
            h, s, e = h[sel], s[sel], e[sel]
            if not len(h):
                continue
            owner = ids[np.searchsorted(o, s, "right") - 1]
            u, low, at = _distinct(_content(d, s, e), owner)
            seen.append((u, low, h[at], (e - s)[at], _gather(d, s[at], (e - s)[at])))
        held.clear()
        if not seen:
            return message(part_of(table), [])
        c, low, h, n = (np.concatenate([x[i] for x in seen]) for i in range(4))
        data = np.concatenate([x[4] for x in seen])
        begin = np.r_[0, np.cumsum(n)[:-1]]
        u, low, at = _distinct(c, low)
        h, n, begin = h[at], n[at], begin[at]
        b = (h % np.uint64(nb)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        bounds = np.searchsorted(b[order], np.arange(nb + 1))
        rows, z = [], zstandard.ZstdCompressor(3)
        for i in range(nb):
            k = order[bounds[i]:bounds[i + 1]]
            if len(k):
                rows.append((i, np.concatenate([u[k], h[k], low[k].view(np.uint64), n[k].astype(np.uint64)]).tobytes(),
                             z.compress(_gather(data, begin[k], n[k]).tobytes())))
        return message(part_of(table), rows)

    def answer_segments(table):
        """To each part, the least doc_id of each string of those segments where another part knows a smaller one."""
        heads = [x.reshape(4, -1) for x in arrays_of(table, "keys", np.uint64)]
        z = zstandard.ZstdDecompressor()
        data = np.concatenate([np.frombuffer(z.decompress(x.as_py()), np.uint8) for x in column(table, "extra")])
        c, h, low, n = (np.concatenate([x[i] for x in heads]) for i in range(4))
        low, n = low.view(np.int64), n.astype(np.int64)
        begin = np.r_[0, np.cumsum(n)[:-1]]
        u, least, at = _distinct(c, low)
        order = np.argsort(h[at], kind="stable")             # whole minimisers together
        u, least, at = u[order], least[order], at[order]
        hs, ns = h[at], n[at]
        new = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        size = np.add.reduceat(ns, new)
        batch = np.cumsum(size) // BATCH
        found = np.empty(int((ns - LENGTH + 1).sum()), np.int64)
        n_str = ns - LENGTH + 1
        upto = np.r_[0, np.cumsum(n_str)]
        cuts = np.r_[new[np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])], len(at)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            found[upto[i]:upto[j]] = least_owner(_gather(data, begin[at[i:j]], ns[i:j]), ns[i:j], least[i:j])
        back = np.argsort(u, kind="stable")
        rows = []
        for x in heads:
            k = back[np.searchsorted(u[back], x[0])]         # distinct segment of each asked one
            own = x[2].view(np.int64)
            m = n_str[k]
            vals = found[np.arange(m.sum()) + np.repeat(upto[k] - np.r_[0, np.cumsum(m)[:-1]], m)]
            smaller = np.logical_or.reduceat(vals < np.repeat(own, m), np.r_[0, np.cumsum(m)[:-1]])
            rows.append((np.concatenate([x[0][smaller], m[smaller].astype(np.uint64)]).tobytes(),
                         vals[np.repeat(smaller, m)].tobytes()))
        return pa.table({"part": column(table, "part"), "bucket": column(table, "bucket"),
                         "keys": pa.array([r[0] for r in rows], pa.binary()),
                         "extra": pa.array([r[1] for r in rows], pa.binary())})

    def cut(table, answers):
        ids_null = column(table, "doc_id").is_null().to_numpy(zero_copy_only=False)
        heads = [x.reshape(2, -1) for x in arrays_of(answers, "keys", np.uint64)] if len(answers) else []
        told = np.concatenate([x[0] for x in heads]) if heads else np.zeros(0, np.uint64)
        told_n = np.concatenate([x[1] for x in heads]).astype(np.int64) if heads else np.zeros(0, np.int64)
        vals = np.concatenate(arrays_of(answers, "extra", np.int64)) if heads else np.zeros(0, np.int64)
        order = np.argsort(told, kind="stable")
        told_at = np.r_[0, np.cumsum(told_n)][:-1][order]
        told = told[order]
        held = []
        for ids, d, o, _, s, e in _chunked(table):
            held.append((ids, d, o, s, e, _content(d, s, e), ids[np.searchsorted(o, s, "right") - 1]))
        known, least = group_min(np.concatenate([np.zeros(0, np.uint64)] + [x[5] for x in held]),
                                 np.concatenate([np.zeros(0, np.int64)] + [x[6] for x in held]))
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for ids, d, o, s, e, c, owner in held:
            flag = np.zeros(len(d) + 1, np.int32)            # starts of strings to remove
            # strings of a segment seen in this part with a smaller document
            gone = least[np.searchsorted(known, c)] < owner
            np.add.at(flag, s[gone], 1)
            np.add.at(flag, e[gone] - LENGTH + 1, -1)
            flag = np.cumsum(flag)
            at = np.searchsorted(told, c)
            hit = np.flatnonzero((at < len(told)) & (told[np.minimum(at, len(told) - 1)] == c)) if len(told) else np.zeros(0, np.int64)
            if len(hit):
                m = (e - s)[hit] - LENGTH + 1
                step = np.arange(m.sum()) - np.repeat(np.r_[0, np.cumsum(m)[:-1]], m)
                low = vals[np.repeat(told_at[at[hit]], m) + step] < np.repeat(owner[hit], m)
                pos = np.repeat(s[hit], m) + step
                flag[pos[low]] = 1
            run = np.cumsum(flag[:len(d)] > 0)
            cov = run > 0
            cov[LENGTH:] = run[LENGTH:] > run[:-LENGTH]
            keep = ~cov
            bounds = np.r_[0, np.cumsum(keep)][o]
            head = cov.copy()
            head[1:] &= ~cov[:-1]
            at = o[:-1][o[:-1] < len(d)]
            head[at] = cov[at]
            spans = np.r_[0, np.cumsum(head)][o]
            flat = memoryview(d[keep].tobytes())
            parts = [flat[bounds[i]:bounds[i + 1]] for i in range(len(ids))]
            out["n_bytes"].append(np.diff(o))
            out["n_removed"].append(np.diff(o) - np.diff(bounds))
            out["n_spans"].append(np.diff(spans))
            out["kept_sha256"] += [hashlib.sha256(p).hexdigest() for p in parts]
            out["kept"] += [bytes(p) if keep_bytes else None for p in parts]
        cat = {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("n_bytes", "n_removed", "n_spans")}
        ids = long_column(table, "doc_id", NULL_ID)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids_null), **{k: pa.array(v, pa.int64()) for k, v in cat.items()},
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})

    parts = dealt(docs)
    repeated = answer(ask(parts, ask_minimisers), count_answer)
    found = answer(meet(parts, repeated, ask_segments, "part int, bucket int, keys binary, extra binary"), answer_segments)
    return meet(parts, found, cut, RESULT)
