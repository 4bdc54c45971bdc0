"""Cross-tokenizer alignment (operator 13): an associative monoid of text fragments.

A text (one space before it) is tokenized by A, a byte-level BPE, and by B, a
SentencePiece BPE.  Byte offsets where tokens of both end cut the two sequences into
groups; within a group, A and B tokens whose bytes overlap are linked.

* A ``Fragment`` is what is known of a byte range from its own tokens: an open prefix
  (up to the first offset where both end), closed groups, and an open suffix.  Two
  neighbours compose by settling the left one's suffix with the right one's prefix,
  which is associative; a fragment without a common offset is all open.  The
  fragments of a text compose to one whose prefix starts at 0 and whose suffix is
  empty.
* Documents above ``LONG_BYTES`` bytes are cut into byte ranges, rows of their own that
  Spark deals to its tasks; the ranges' fragments are composed by tree reduction,
  ``FAN_IN`` neighbours a round.  The tokens of A and of B in a range begin at the
  first place from its nominal edge where that tokenizer's tokens surely end (A: a
  space before other text; B: a run of markers behind other text), so the two sides
  of a range differ and its ends are open.
* Shorter documents are ranges of one task.  Places that are sure for both make
  pieces without open ends; a distinct piece is tokenized and aligned once per block of
  ``BLOCK_BYTES``.
* Counts of linked id pairs are exact sums over the corpus: documents are packed into
  units of about ``UNIT_BYTES`` of text, a unit tells each of its distinct pairs once, and
  gets the pairs' counts back by joins on pair and unit.  The highest count of a B id
  has a row for each id of the vocabulary at most.

The vocabularies are read by the driver and sent to the tasks (at most 64 MB each).
A's merges are run by the tiktoken library, whose order of merges is that of the ids;
``load_pair`` checks that the file's merges have that order, the tests that the ids agree.

Edge cases: texts null, empty, or that B does not give back as they were (such as texts
that hold U+2581) have no tokens: zeros and an empty digest; very long texts are cut
as above, a text without a sure place stays in one range; repeated rows and ids are
documents of their own; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import reduce
from itertools import batched, chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged
from .pieces import MARK, blocks, cuttable, load_model, words_of

LONG_BYTES = 1 << 16
RANGE_CHARS = 1 << 15
FAN_IN = 16
UNIT_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
OTHER_SPACES = r"᠎​﻿"      # white space of some Unicode versions
A_CUT = re.compile(rf" (?=[^\s{OTHER_SPACES}])")                          # A's tokens end before this space
B_CUT = re.compile("(?<=[^ ▁])(?=[ ▁]+[^ ▁])")             # B's tokens end here
BOTH_CUT = re.compile(rf"(?<=[^ ▁])(?= [^\s{OTHER_SPACES}▁])")
# texts that are not just split at their spaces: white space at the begin, behind a space or a space at the end, U+2581
_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}\x{180e}\x{200b}\x{feff}]"
NOT_PLAIN = rf"^{_WHITE}| {_WHITE}|\x{{2581}}| $|^$"
# words that others may not follow or precede without a change to tokens
WHITE_EDGE = rf"^{_WHITE}| $|^$"
RUN_WORDS = 4096
TENS = 10 ** np.arange(1, 19)
NONE = np.zeros((2, 0), np.int64)


# -- the monoid ------------------------------------------------------------------------

class Fragment(NamedTuple):
    """Tokens are arrays (id, end) by columns; ends are byte offsets in the text.

    ``solid``: no common end inside, all tokens are in the prefix.  ``groups`` are the
    closed groups joined by ';', ``pairs`` and ``counts`` their links (A id << 32 | B id).
    """
    ok: bool = True
    solid: bool = True
    a_prefix: np.ndarray = NONE
    b_prefix: np.ndarray = NONE
    groups: bytes = b""
    n_a: int = 0
    n_b: int = 0
    pairs: np.ndarray = np.zeros(0, np.int64)
    counts: np.ndarray = np.zeros(0, np.int64)
    a_suffix: np.ndarray = NONE
    b_suffix: np.ndarray = NONE


BROKEN = Fragment(ok=False)     # of a text that B does not give back: absorbs its neighbours


def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The values of two ascending arrays that are in both."""
    if not len(x) or not len(y):
        return x[:0]
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x]


def either(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct values of two ascending arrays."""
    z = np.sort(np.concatenate([x, y]), kind="stable")
    return z[np.r_[True, z[1:] != z[:-1]]] if len(z) else z


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... (size[i] of them), for all i."""
    ends = np.cumsum(size)
    return np.repeat(first - np.r_[0, ends[:-1]], size) + np.arange(ends[-1] if len(size) else 0)


def links(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pairs of tokens that overlap, in order; both sides begin and end at the same offset, ``ends`` are all ends.

    Between two neighbouring ends of either side lies one token of each, and two
    tokens overlap in exactly one such interval.
    """
    return a[0][np.searchsorted(a[1], ends)] << 32 | b[0][np.searchsorted(b[1], ends)]


def group_text(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The text 'a1,a2|b1;' of the groups that end at ``common``, and its length up to each group's end."""
    if not len(common):
        return b"", np.zeros(0, np.int64)
    sides = []
    for x, last in ((a, 1), (b, 2)):
        group = np.searchsorted(common, x[1])
        sides.append((2 * group + (last - 1), x[0], np.where(common[group] == x[1], last, 0)))
    key, ids, mark = (np.concatenate(v) for v in zip(*sides))
    order = np.argsort(key, kind="stable")
    ids, mark = ids[order], mark[order]
    digits = np.searchsorted(TENS, ids, "right") + 1
    stop = np.cumsum(digits + 1)
    out = np.empty(stop[-1], np.uint8)
    out[stop - 1] = np.frombuffer(b",|;", np.uint8)[mark]
    for k in range(digits.max()):               # the k-th digit from the right
        have = digits > k
        out[stop[have] - 2 - k] = 48 + ids[have] // 10**k % 10
    count = np.searchsorted(a[1], common, "right") + np.searchsorted(b[1], common, "right")
    return out.tobytes(), stop[count - 1]


def tally(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and how often each occurs."""
    k = np.sort(pairs)
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.diff(np.r_[at, len(k)])


def joined(*parts: bytes) -> bytes:
    return b";".join([p for p in parts if p])


def settle(a: np.ndarray, b: np.ndarray, closed_before: bool) -> Fragment:
    """The fragment of neighbouring tokens; ``closed_before``: a common end lies right before them."""
    common = both(a[1], b[1])
    if not len(common):
        if not closed_before:
            return Fragment(a_prefix=a, b_prefix=b)
        return Fragment(solid=False, a_suffix=a, b_suffix=b)
    i, j = np.searchsorted(a[1], common[[0, -1]], "right"), np.searchsorted(b[1], common[[0, -1]], "right")
    p, q = (0, 0) if closed_before else (i[0], j[0])
    inner = common if closed_before else common[1:]
    ac, bc = a[:, p:i[1]], b[:, q:j[1]]
    pairs, counts = tally(links(ac, bc, either(ac[1], bc[1])))
    return Fragment(True, False, a[:, :p], b[:, :q], group_text(ac, bc, inner)[0][:-1],
                    ac.shape[1], bc.shape[1], pairs, counts, a[:, i[1]:], b[:, j[1]:])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges (associative; an empty solid fragment is neutral)."""
    if not (x.ok and y.ok):
        return BROKEN
    a = np.concatenate([x.a_prefix if x.solid else x.a_suffix, y.a_prefix], 1)
    b = np.concatenate([x.b_prefix if x.solid else x.b_suffix, y.b_prefix], 1)
    mid = settle(a, b, not x.solid)
    if x.solid and y.solid:
        return mid
    left = mid if x.solid else x
    pairs, counts = merged([(f.pairs, f.counts) for f in ([] if x.solid else [x]) + [mid] + ([] if y.solid else [y])])
    return Fragment(True, False, left.a_prefix, left.b_prefix,
                    joined(b"" if x.solid else x.groups, mid.groups, b"" if y.solid else y.groups),
                    (0 if x.solid else x.n_a) + mid.n_a + (0 if y.solid else y.n_a),
                    (0 if x.solid else x.n_b) + mid.n_b + (0 if y.solid else y.n_b), pairs, counts,
                    mid.a_suffix if y.solid else y.a_suffix, mid.b_suffix if y.solid else y.b_suffix)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by pair, pairs ascending."""
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return Fragment().pairs, Fragment().counts
    k, c = (np.concatenate(v) for v in zip(*parts))
    o = np.argsort(k, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(k[o]) != 0])
    return k[o][at], np.add.reduceat(c[o], at)


def composed(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments composed as a balanced tree."""
    while len(parts) > 1:
        parts = [reduce(compose, parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else Fragment()


def whole_text(f: Fragment) -> Fragment:
    """A text's fragment, whose prefix begins at 0: everything closed."""
    if not f.ok:
        return BROKEN
    return compose(Fragment(solid=False), f)


# -- tokens ------------------------------------------------------------------------------

def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [i for i in range(256) if i not in plain]
    return {chr(i): i for i in plain} | {chr(256 + n): i for n, i in enumerate(rest)}


# FIXED VALUE: how byte-level BPE of this kind parts a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_pair(a_path: str, b_path: str) -> tuple[dict[bytes, int], bytes]:
    """(A's tokens in the order of their merges, B's model), checked: the places where tokens surely end hold for these kinds only."""
    spec, b = json.loads(load_model(a_path)), load_model(b_path)
    pre, model, symbol = spec["pre_tokenizer"] or {}, spec["model"], byte_symbols()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    vocab = model["vocab"]
    plain = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") \
        and pre.get("use_regex", True) and not model.get("ignore_merges") and not model.get("dropout")
    # ids ascend as the merges do, so the lowest id is the merge that comes first
    if not plain or [vocab[m] for m in merged] != list(range(256, 256 + len(merged))) or any(vocab.get(c, 256) > 255 for c in symbol):
        raise ValueError(f"{Path(a_path).name} is no plain byte-level BPE")
    if not cuttable(b):
        raise ValueError(f"{Path(b_path).name} is no BPE whose pieces stay within marked words")
    return {bytes(symbol[c] for c in t): vocab[t] for t in [*symbol, *merged]}, b


class Tokens:
    """Both tokenizers in a task."""

    def __init__(self, a_ranks: dict[bytes, int], b_model: bytes):
        import sentencepiece
        import tiktoken
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=a_ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = sorted(a_ranks, key=a_ranks.get)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def side(self, ids: list, size: np.ndarray, at: int) -> np.ndarray:
        x = np.array(ids, np.int64)
        return np.array([x, at + np.cumsum(size[x])])

    def tokenized(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A's tokens, B's tokens, end of each piece) of pieces behind each other, each a space and a word that B gives back.

        Both sides end where a plain piece ends, so plain ones are given to the libraries in runs.
        """
        a, b = [], []
        for run in chain(map(" ".join, batched(plain, RUN_WORDS)), odd):
            a += self.a.encode_ordinary(" " + run)
            b += self.b.encode(run)
        if b"".join(map(self.a_bytes.__getitem__, a)) != b"".join(map(self.b_bytes.__getitem__, b)):
            raise ValueError("the tokenizers do not give the texts back")
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in chain(plain, odd)), np.int64, len(plain) + len(odd)) + 1)
        return self.side(a, self.a_size, 0), self.side(b, self.b_size, 0), ends

    def closed(self, words: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gives back, groups with a ';' behind each, A tokens, links, first link, number of links) of distinct pieces, each a space and a word.

        Both ends of a piece are common, so the pieces are aligned side by side.
        """
        def matches(pattern):
            return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)

        good, odd = ~matches(MARK), matches(WHITE_EDGE)
        parts = [np.flatnonzero(good & ~odd), np.flatnonzero(good & odd)]
        order = np.concatenate(parts)
        a, b, ends = self.tokenized(*(words.take(pa.array(p)).to_pylist() for p in parts))
        common, every = both(a[1], b[1]), either(a[1], b[1])
        text, upto = group_text(a, b, common)
        groups, (n_a, first, size) = [b""] * len(words), np.zeros((3, len(words)), np.int64)
        to = upto[np.searchsorted(common, ends)].tolist()
        for i, p, q in zip(order.tolist(), [0, *to], to):
            groups[i] = text[p:q]
        n_a[order] = np.diff(np.r_[0, np.searchsorted(a[1], ends, "right")])
        at = np.r_[0, np.searchsorted(every, ends, "right")]
        first[order], size[order] = at[:-1], np.diff(at)
        return good, groups, n_a, links(a, b, every), first, size

    def open_part(self, a_text: str, a_at: int, b_text: str, b_at: int) -> Fragment:
        """The fragment of a range whose A side is ``a_text`` from byte ``a_at`` and whose B side is ``b_text``."""
        a = self.a.encode_ordinary(a_text)
        b = self.b.encode(b_text[1:]) if b_text else []
        if b"".join(map(self.a_bytes.__getitem__, a)) != a_text.encode() or b"".join(map(self.b_bytes.__getitem__, b)) != b_text.encode():
            return BROKEN
        return settle(self.side(a, self.a_size, a_at), self.side(b, self.b_size, b_at), False)

    def range_fragment(self, text: str, at: int, a0: int, a1: int, b0: int, b1: int) -> Fragment:
        """The fragment of a range: ``text`` from byte ``at``, A's side text[a0:a1], B's side text[b0:b1].

        The places in both sides that are sure for both tokenizers bound pieces without
        open ends; only what lies before the first and behind the last is open.
        """
        def byte(i):
            return at + len(text[:i].encode())

        lo, hi = max(a0, b0), min(a1, b1)
        cuts = [m.start() for m in BOTH_CUT.finditer(text, lo, hi)] if lo < hi else []
        cuts = [c for c in cuts if c > lo]
        if lo == a0 == b0 and lo < hi:
            cuts.insert(0, lo)
        if len(cuts) < 2:
            return self.open_part(text[a0:a1], byte(a0), text[b0:b1], byte(b0))
        first, last = cuts[0], cuts[-1]
        before = self.open_part(text[a0:first], byte(a0), text[b0:first], byte(b0))
        after = self.open_part(text[last:a1], byte(last), text[last:b1], byte(last))
        words, which = np.unique(np.array([text[i + 1:j] for i, j in zip(cuts, cuts[1:])], object), return_inverse=True)
        ok, groups, n_a, found, first_link, size = self.closed(pa.array(words, pa.large_string()))
        if not ok.all():
            return BROKEN
        pairs, times = merged([(found[spread(first_link, size)], np.repeat(np.bincount(which, minlength=len(words)), size))])
        text_of, n = b"".join(map(groups.__getitem__, which.tolist()))[:-1], int(n_a[which].sum())
        # a range that has nothing open at `first`: its neighbour's tokens end there too
        middle = Fragment(True, False, NONE, NONE, text_of, n, int(times.sum()) + text_of.count(b";") + 1 - n, pairs, times)
        return composed([before, middle, after])

    def documents(self, texts: pa.Array) -> list[tuple]:
        """For each whole text (gives back, groups, A tokens, link pairs, their counts): its pieces composed, none has open ends."""
        words, first = words_of(texts, NOT_PLAIN, lambda t: [p[1:] for p in BOTH_CUT.split(" " + t)])
        coded = words.dictionary_encode()
        which = np.asarray(coded.indices)
        ok, groups, n_a, found, first_link, size = self.closed(coded.dictionary)
        flat = found[spread(first_link[which], size[which])]
        ends = np.r_[0, np.cumsum(size[which])]
        bad = np.r_[0, np.cumsum(~ok[which])]
        tokens = np.r_[0, np.cumsum(n_a[which])]
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if i == j or bad[j] > bad[i]:
                out.append(BLANK)
            else:
                text = b"".join(map(groups.__getitem__, which[i:j].tolist()))[:-1]
                out.append((True, text, int(tokens[j] - tokens[i]), *tally(flat[ends[i]:ends[j]])))
        return out


BLANK = (False, b"", 0, np.zeros(0, np.int64), np.zeros(0, np.int64))


# -- Spark ---------------------------------------------------------------------------------

UNIT = ("unit long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
        "upto binary, place binary, times binary, pairs array<long>, totals array<long>")
RANGE = "doc long, doc_id long, no int, n_ranges int, at long, a0 int, a1 int, b0 int, b1 int, text string"
PART = ("doc long, doc_id long, no int, ok boolean, solid boolean, a_prefix binary, b_prefix binary, groups binary, n_a long, n_b long, "
        "pairs binary, counts binary, a_suffix binary, b_suffix binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (f.split() for f in ddl.split(", "))])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


DOC = pa.struct([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
UNIT_ARROW = pa.schema([("unit", pa.int64()), ("docs", pa.list_(DOC)), *((n, pa.binary()) for n in ("upto", "place", "times")),
                        *((n, pa.list_(pa.int64())) for n in ("pairs", "totals"))])


class Unit:
    """Aligned documents of a task, until their texts fill a unit."""

    def __init__(self):
        self.docs, self.pairs, self.counts, self.size = [], [], [], 0

    def add(self, doc_id, ok: bool, groups: bytes, n_a: int, pairs: np.ndarray, counts: np.ndarray, size: int) -> None:
        n_links, n_groups = int(counts.sum()), groups.count(b";") + 1 if ok else 0
        # a group of x and y tokens has x + y - 1 links
        self.docs.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_links + n_groups - n_a, "n_groups": n_groups, "n_links": n_links,
                          "groups_sha256": hashlib.sha256(groups).hexdigest() if ok else ""})
        self.pairs.append(pairs)
        self.counts.append(counts)
        self.size += size + 64

    def row(self) -> pa.RecordBatch:
        flat, times = np.concatenate(self.pairs), np.concatenate(self.counts)
        distinct, _ = tally(flat)
        place = np.searchsorted(distinct, flat)
        totals = np.bincount(place, times, len(distinct)).astype(np.int64)
        upto = np.cumsum([len(p) for p in self.pairs])
        unit = int.from_bytes(os.urandom(8), "little") >> 1     # the units are written at once, so a task that runs again does no harm
        return pa.RecordBatch.from_arrays([
            pa.array([unit]), pa.array([self.docs], pa.list_(DOC)), *(pa.array([x.tobytes()], pa.binary()) for x in (
                upto.astype(np.int64), place.astype(np.uint32), times.astype(np.uint32))),
            *(pa.array([x], pa.list_(pa.int64())) for x in (distinct, totals))], schema=UNIT_ARROW)


def packed(rows):
    """Unit rows of (doc_id, ok, groups, A tokens, pairs, counts, bytes of text)."""
    unit = Unit()
    for r in rows:
        unit.add(*r)
        if unit.size >= UNIT_BYTES:
            yield unit.row()
            unit = Unit()
    if unit.docs:
        yield unit.row()


def ranges_of(text: str) -> list[tuple]:
    """(byte of the slice, a0, a1, b0, b1 in it, slice) of each range of a text."""
    full = " " + text
    edges = {}
    for side, cut in (("a", A_CUT), ("b", B_CUT)):
        at = [0]
        for e in range(RANGE_CHARS, len(full), RANGE_CHARS):
            m = cut.search(full, max(e, at[-1]))
            at.append(m.start() if m else len(full))
        edges[side] = [*at, len(full)]
    out, byte, char = [], 0, 0
    for a0, a1, b0, b1 in zip(edges["a"], edges["a"][1:], edges["b"], edges["b"][1:]):
        lo = min(a0, b0)
        byte, char = byte + len(full[char:lo].encode()), lo
        out.append((byte, a0 - lo, a1 - lo, b0 - lo, b1 - lo, full[lo:max(a1, b1)]))
    return out


def to_row(doc: int, doc_id, no: int, f: Fragment) -> tuple:
    return (doc, doc_id, no, f.ok, f.solid, f.a_prefix.tobytes(), f.b_prefix.tobytes(), f.groups, f.n_a, f.n_b, f.pairs.tobytes(),
            f.counts.tobytes(), f.a_suffix.tobytes(), f.b_suffix.tobytes())


def from_row(r: dict) -> Fragment:
    def side(x):
        return np.frombuffer(x, np.int64).reshape(2, -1)

    return Fragment(r["ok"], r["solid"], side(r["a_prefix"]), side(r["b_prefix"]), r["groups"], r["n_a"], r["n_b"],
                    np.frombuffer(r["pairs"], np.int64), np.frombuffer(r["counts"], np.int64), side(r["a_suffix"]), side(r["b_suffix"]))


def short_units(docs: DataFrame, a: dict, b: bytes) -> DataFrame:
    """Documents of at most LONG_BYTES bytes, aligned whole and packed into units."""
    def run(batches):
        tokens = Tokens(a, b)

        def rows():
            for x in batches:
                ids, texts = x.column(0).to_pylist(), x.column(1)
                i = 0
                for part in blocks(texts, BLOCK_BYTES):
                    sizes = pc.binary_length(part).fill_null(0).to_pylist()
                    for got, size in zip(tokens.documents(part), sizes):
                        yield ids[i], *got, size
                        i += 1

        yield from packed(rows())

    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONG_BYTES)
    return short.mapInArrow(run, UNIT)


def long_fragments(docs: DataFrame, a: dict, b: bytes) -> tuple[DataFrame, int]:
    """The fragments of the ranges of longer documents, and the largest number of ranges (0: there are none)."""
    def cut(batches):
        schema = arrow_schema(RANGE)
        for x in batches:
            for doc_id, text in zip(x.column(0).to_pylist(), x.column(1)):
                doc = int.from_bytes(os.urandom(8), "little") >> 1      # the ranges are written at once
                parts = ranges_of(text.as_py())
                yield batch([(doc, doc_id, no, len(parts), *p) for no, p in enumerate(parts)], schema)

    def align(batches):
        tokens, schema = Tokens(a, b), arrow_schema(PART)
        for x in batches:
            for r in (x.slice(i, 1).to_pylist()[0] for i in range(len(x))):
                f = tokens.range_fragment(r["text"], r["at"], r["a0"], r["a1"], r["b0"], r["b1"])
                yield batch([to_row(r["doc"], r["doc_id"], r["no"], f)], schema)

    ranges = staged(docs.filter(F.octet_length("text") > LONG_BYTES).mapInArrow(cut, RANGE), "ranges")
    most = ranges.agg(F.max("n_ranges")).first()[0] or 0
    dealt = ranges.repartition(shuffle_partitions(docs.sparkSession), "doc", "no")
    return dealt.mapInArrow(align, PART), most


def reduced(parts: DataFrame, most: int) -> DataFrame:
    """One fragment per document: rounds of ``FAN_IN`` neighbours."""
    def step(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        f = composed([from_row(r) for r in rows])
        return pa.Table.from_batches([batch([to_row(rows[0]["doc"], rows[0]["doc_id"], rows[0]["no"] // FAN_IN, f)], arrow_schema(PART))])

    while most > 1:
        parts = parts.groupBy("doc", F.floor(F.col("no") / FAN_IN).alias("next")).applyInArrow(lambda t: step(t), PART)
        most = -(-most // FAN_IN)
    return parts


def long_units(parts: DataFrame) -> DataFrame:
    def run(batches):
        def rows():
            for x in batches:
                for r in x.to_pylist():
                    f = whole_text(from_row(r))
                    yield r["doc_id"], f.ok, f.groups, f.n_a, f.pairs, f.counts, len(f.groups)

        yield from packed(rows())

    return parts.mapInArrow(run, UNIT)


def aligned_units(docs: DataFrame, a: dict, b: bytes) -> DataFrame:
    """All documents, aligned and packed into units (a written table)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = short_units(docs, a, b)
    parts, most = long_fragments(docs, a, b)
    if most:
        units = units.unionByName(long_units(reduced(parts, most)))
    return staged(units, "units")


def pair_counts(units: DataFrame) -> DataFrame:
    """(pair, n, top): links of each id pair corpus-wide, and whether no pair of its B id has more."""
    pairs = units.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select("x.*")
    known = staged(pairs.groupBy("pairs").agg(F.sum("totals").alias("n")), "pairs")
    b_id = F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    best = known.groupBy(b_id).agg(F.max("n").alias("most"))        # a row for each id of B's vocabulary at most
    return known.withColumn("b_id", b_id).join(best, "b_id").select(F.col("pairs").alias("pair"), "n", (F.col("n") == F.col("most")).alias("top"))


def links_report(units: DataFrame) -> DataFrame:
    """Per document its digest and the sums over its links."""
    told = units.select("unit", F.posexplode("pairs").alias("pos", "pair"))
    heard = told.join(pair_counts(units), "pair").groupBy("unit").agg(
        F.sort_array(F.collect_list(F.struct("pos", "n", "top"))).alias("heard"))
    heard = heard.select("unit", F.col("heard.n").alias("n"), F.col("heard.top").alias("top"))

    def run(batches):
        schema = arrow_schema(RESULT)
        for x in batches:
            for r in (x.slice(i, 1).to_pylist()[0] for i in range(len(x))):
                upto, place, times = (np.frombuffer(r[k], t) for k, t in (("upto", np.int64), ("place", np.uint32), ("times", np.uint32)))
                n, top = np.array(r["n"] or [], np.int64), np.array(r["top"] or [], np.int64)
                sums = np.r_[0, np.cumsum(n[place] * times)], np.r_[0, np.cumsum(top[place] * times)]
                at = np.r_[0, upto]
                total, best = (np.diff(s[at]).tolist() for s in sums)
                yield batch([(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], y, s, d["groups_sha256"])
                             for d, s, y in zip(r["docs"], total, best)], schema)

    rows = units.drop("pairs", "totals").join(heard, "unit", "left")
    return rows.mapInArrow(run, RESULT)


def align(docs: DataFrame, a: dict, b: bytes) -> DataFrame:
    """Per document: tokens, groups and links of the two tokenizers, and how its links stand among the corpus's."""
    return links_report(aligned_units(docs, a, b))
