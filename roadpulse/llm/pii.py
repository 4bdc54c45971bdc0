"""Personal data (operator 6): base patterns plus a linear-chain conditional random field.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers; their
spans always stay.  A linear-chain CRF over word-shape features, trained from a
small labelled table, adds spans of the same kinds that the patterns miss (a
spaced address, a phone number without its plus, a card number with dots).

The labelled table: windows of words around digits, ``@`` and ``+`` of a bounded
sample of documents, labelled by the base patterns, and for each labelled span a
rewritten copy (``VARIANTS``) with the same labels.  Equal windows are one row with
their number.  The rows are bounded by a hash of the window: about ``TRAIN_WINDOWS``
without a span and ``SPAN_WINDOWS`` of each combination of kinds, so that neither
what sorts first nor what is frequent crowds the others out.  Training is full-batch
gradient ascent in numpy, each row weighted by its number.  Decoding is
Viterbi in numpy over batches of windows; words further than ``CONTEXT`` words
from a digit, ``@`` or ``+`` are outside every window and carry no label.

Scale: one Arrow-batched projection of the text; no shuffle.  The model's size is
bounded by the features of the training windows.

Edge cases: null text counts as empty; without a labelled span in the sample the
model labels nothing; an empty table gives an empty result; repeated rows are
searched each; only doc_id and text are read; very long texts and words are searched
whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

# FIXED VALUES: the kinds and base patterns (email's parts: local run, then domain)
KINDS = ["email", "ip", "card", "phone"]
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRAIN_DOCS = 6000
TRAIN_WINDOWS = 3000        # distinct windows without a labelled span
SPAN_WINDOWS = 1000         # distinct windows of each combination of labelled kinds
CONTEXT = 2
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
EPOCHS, RATE, RIDGE = 120, 0.5, 1e-3
DECODE = 1 << 15            # words decoded at once
HOT = re.compile(r"[0-9@+]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- base patterns --------------------------------------------------------------------

def _emails(text: str):
    """Leftmost non-overlapping: a local part reaches from its ``@`` to its run's start or the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in EMAIL_LOCAL:
            s -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if s < at else None
        if m:
            end = m.end()
            yield s, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, ordered."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- windows and features -------------------------------------------------------------

SHAPE = 64


def shape(word: str) -> str:
    """Letters a/A, digits 9, other characters as they are; runs of digits longer than four are cut to four, others to one.

    Of the whole word; beyond ``SHAPE`` signs only which ones there are.
    """
    out, last, run = [], "", 0
    for c in word:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run <= (4 if k == "9" else 1):
            out.append(k)
    return "".join(out[:SHAPE]) + "".join(sorted(set(out[SHAPE:])))


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Word spans around words that hold a digit, ``@`` or ``+``, with CONTEXT words on each side."""
    if not HOT.search(text):
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    hot = [i for i, (s, e) in enumerate(spans) if HOT.search(text, s, e)]
    out: list[list[int]] = []
    for i in hot:
        lo, hi = max(0, i - CONTEXT), min(len(spans), i + CONTEXT + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [spans[lo:hi] for lo, hi in out]


def labels_of(window: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[int]:
    """BIO labels of the words that base spans cover; a longer span wins over one inside it."""
    out = [0] * len(window)
    for s, k, e in sorted(found, key=lambda x: x[0] - x[2], reverse=True):
        inside = [i for i, (a, b) in enumerate(window) if a < e and s < b]
        for n, i in enumerate(inside):
            out[i] = 1 + 2 * k + (n > 0)
    return out


VARIANTS = {   # rewritten copies of a labelled span's words, by kind
    0: lambda ws: [x for w in ws for x in w.replace("@", " @ ").split()],
    1: lambda ws: [w.replace(".", "-") for w in ws],
    2: lambda ws: [w.replace("-", ".") if "-" in w else re.sub(r"(?<=\d{4})(?=\d)", ".", w) if w.isdigit() and len(w) == 16 else w for w in ws],
    3: lambda ws: [w.replace("+", "00", 1) if i == 0 else w for i, w in enumerate(ws)],
}


def labelled_windows(text: str) -> list[tuple[list[str], list[int]]]:
    """(shapes, labels) of each window, and of its rewritten copy where it holds a span."""
    found, out = base_spans(text), []
    for win in windows(text):
        words, lab = [text[a:b] for a, b in win], labels_of(win, found)
        out.append(([shape(w) for w in words], lab))
        if any(lab):
            w2, l2, i = [], [], 0
            while i < len(words):
                j = i + 1
                if lab[i]:
                    while j < len(words) and lab[j] == lab[i] + (lab[i] % 2):
                        j += 1
                    k = (lab[i] - 1) // 2
                    new = VARIANTS[k](words[i:j])
                    w2 += new
                    l2 += [1 + 2 * k + (n > 0) for n in range(len(new))]
                else:
                    w2.append(words[i])
                    l2.append(0)
                i = j
            out.append(([shape(w) for w in w2], l2))
    return out


def features(shapes: list[str]) -> list[list[str]]:
    """Features of each word: its own shape, its neighbours' shapes, and coarse marks."""
    pad = ["<", *shapes, ">"]
    out = []
    for i, s in enumerate(shapes, 1):
        f = ["s=" + s, "p=" + pad[i - 1], "n=" + pad[i + 1], "c=" + re.sub(r"(.)\1+", r"\1", s), "bias"]
        f += [m for m, yes in (("@", "@" in s), ("9.", "9." in s), ("+", "+" in s), ("plain", not HOT.search(s))) if yes]
        out.append(f)
    return out


# -- the chain ------------------------------------------------------------------------

def _batch(seqs, index: dict[str, int]):
    """Padded feature ids [n, t, f] (last row of the weights: nothing), lengths."""
    t, w = max(len(s) for s in seqs), 9
    ids = np.full((len(seqs), t, w), len(index), np.int64)
    for i, s in enumerate(seqs):
        for j, f in enumerate(features(s)):
            got = [index[x] for x in f if x in index]
            ids[i, j, :len(got)] = got
    return ids, np.array([len(s) for s in seqs])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(samples: list[tuple[list[str], list[int], int]]) -> dict:
    """Weights that maximise the conditional likelihood of the labelled windows (shapes, labels, number), with a ridge."""
    n_l = len(LABELS)
    index = {f: i for i, f in enumerate(sorted({f for s, _, _ in samples for x in features(s) for f in x}))}
    w, tr = np.zeros((len(index) + 1, n_l)), np.zeros((n_l, n_l))
    if not any(any(y) for _, y, _ in samples):
        return {"index": {}, "w": np.zeros((1, n_l)), "tr": tr, "empty": True}
    groups: dict[int, list] = {}
    for s, y, c in samples:
        groups.setdefault(len(s), []).append((s, y, c))
    data = [(_batch([s for s, _, _ in g], index)[0], np.array([y for _, y, _ in g]), np.array([c for _, _, c in g], float))
            for _, g in sorted(groups.items())]
    total = sum(c for _, _, c in samples)
    gw, gt = np.zeros_like(w), np.zeros_like(tr)
    for _ in range(EPOCHS):
        dw, dt = -RIDGE * total * w, -RIDGE * total * tr
        for ids, y, c in data:
            n, t, _ = ids.shape
            em = w[ids].sum(axis=2)
            fwd, bwd = [em[:, 0]], [np.zeros((n, n_l))]
            for i in range(1, t):
                fwd.append(_logsumexp(fwd[-1][:, :, None] + tr, 1) + em[:, i])
            for i in range(t - 1, 0, -1):
                bwd.append(_logsumexp(tr + (em[:, i] + bwd[-1])[:, None, :], 2))
            bwd = bwd[::-1]
            z = _logsumexp(fwd[-1], 1)
            for i in range(t):
                p = -np.exp(fwd[i] + bwd[i] - z[:, None])
                p[np.arange(n), y[:, i]] += 1
                p *= c[:, None]
                np.add.at(dw, ids[:, i].ravel(), np.repeat(p, ids.shape[2], axis=0))
                if i:
                    q = np.exp(fwd[i - 1][:, :, None] + tr + (em[:, i] + bwd[i])[:, None, :] - z[:, None, None])
                    dt -= (q * c[:, None, None]).sum(axis=0)
                    np.add.at(dt, (y[:, i - 1], y[:, i]), c)
        dw[-1] = 0
        gw += dw * dw
        gt += dt * dt
        w += RATE * dw / np.sqrt(gw + 1e-8)
        tr += RATE * dt / np.sqrt(gt + 1e-8)
    return {"index": index, "w": w, "tr": tr, "empty": False}


def viterbi(em: np.ndarray, lengths: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best label sequences of a padded batch [n, t, labels]."""
    n, t, n_l = em.shape
    best, back = em[:, 0].copy(), np.zeros((t, n, n_l), np.int8)
    for i in range(1, t):
        x = best[:, :, None] + tr
        back[i] = x.argmax(axis=1)
        on = (i < lengths)[:, None]
        back[i] = np.where(on, back[i], np.arange(n_l))
        best = np.where(on, x.max(axis=1) + em[:, i], best)
    out = np.zeros((n, t), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[i][np.arange(n), out[:, i]]
    return out


def decode(model: dict, seqs: list[list[str]]) -> list[np.ndarray]:
    """Labels of each window, decoded in batches of windows of like length."""
    out: list = [None] * len(seqs)
    order, i = sorted(range(len(seqs)), key=lambda k: len(seqs[k])), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(seqs[order[j]]) <= DECODE:
            j += 1
        ids, lengths = _batch([seqs[k] for k in order[i:j]], model["index"])
        got = viterbi(model["w"][ids].sum(axis=2), lengths, model["tr"])
        for row, k, n in zip(got, order[i:j], lengths):
            out[k] = row[:n]
        i = j
    return out


def label_spans(text: str, window: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of equal kind, without punctuation at their ends."""
    out, i = [], 0
    while i < len(window):
        k, j = (int(labels[i]) - 1) // 2, i + 1
        if labels[i]:
            while j < len(window) and labels[j] == 2 + 2 * k:
                j += 1
            s, e = window[i][0], window[j - 1][1]
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while s < e and not text[e - 1].isalnum():
                e -= 1
            if s < e:
                out.append((s, k, e))
        i = j
    return out


def label_batch(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    wins = [] if model["empty"] else [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    labels = decode(model, [[shape(texts[i][a:b]) for a, b in w] for i, w in wins])
    added: list[list] = [[] for _ in texts]
    for (i, w), lab in zip(wins, labels):
        if lab.any():
            added[i] += [x for x in label_spans(texts[i], w, lab)
                         if not any(x[0] < e and s < x[2] for s, _, e in base[i])]
    return list(zip(base, added))


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def labelled_table(docs: DataFrame) -> list[tuple[list[str], list[int], int]]:
    """The small labelled table: distinct windows of a bounded sample of documents and their numbers."""
    def run(batches):
        for b in batches:
            got = [x for t in b.column("text").to_pylist() for x in labelled_windows(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.list_(pa.string())),
                                              pa.array([x[1] for x in got], pa.list_(pa.int32()))], ["shapes", "labels"])

    # the kinds of a window as bits; 0 without a labelled span
    kinds = F.aggregate(F.array_distinct(F.expr("transform(filter(labels, x -> x > 0), x -> cast(power(2, (x - 1) div 2) as int))")),
                        F.lit(0), lambda a, x: a + x)
    rows = (bounded_sample(docs.select("doc_id", "text"), TRAIN_DOCS).select("text")
            .mapInArrow(run, "shapes array<string>, labels array<int>").groupBy("shapes", "labels").agg(F.count("*").alias("n"))
            .withColumn("kinds", kinds).cache())
    try:
        share = F.lit(0)
        for r in rows.groupBy("kinds").agg(F.count("*").alias("n")).collect():
            bound = SPAN_WINDOWS if r["kinds"] else TRAIN_WINDOWS
            share = F.when(F.col("kinds") == r["kinds"], min(1 << 30, -(-(bound << 30) // r["n"]))).otherwise(share)
        h = F.pmod(F.xxhash64(F.lit("window"), "shapes", "labels"), F.lit(1 << 30))
        got = rows.filter(h < share).collect()
    finally:
        rows.unpersist()
    return sorted((list(r["shapes"]), list(r["labels"]), r["n"]) for r in got)


def find(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, base counts and digest, and all spans."""
    def run(batches):
        for b in batches:
            got = label_batch([t or "" for t in b.column("text").to_pylist()], model)
            counts = [[sum(x[1] == k for x in base) for base, _ in got] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in got], pa.string()),
                 pa.array([_text(base + more) for base, more in got], pa.string()),
                 pa.array([len(more) for _, more in got], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
