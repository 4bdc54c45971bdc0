"""SentencePiece encoding and decoding (operator 12): a table of distinct marked words.

The library turns every space into the marker U+2581 and puts one before the text.
Where no piece of the model has a marker behind another character, no merge can
cross the place before a run of markers, so the marked words of a text are
segmented independently of each other:

* Encoding cuts a text before each run of markers.  A table holds the ids of every
  distinct marked word; the library segments a word when it is first met, and the
  ids of the text are the words' ids, joined by position.
* Decoding joins the texts of the pieces by position; a run of byte pieces beyond
  ASCII is decoded whole, each distinct run once.

Models that fail the check (other kinds than BPE, pieces across markers, a normaliser
that changes text) are given whole texts, with equal results.

Scale: one Arrow-batched projection of the texts, without a shuffle.  Each task has
its own tables: a corpus-wide table would cost a shuffle of the texts to spare work
that is a small part of a task's.  A table that exceeds ``TABLE_WORDS`` words starts
anew, and words above ``LONG_WORD`` characters are segmented but not kept; both only
cost work.  The model file is read by the driver and sent to the tasks (at most
``MODEL_BYTES``), so executors need no copy of it.

Edge cases: a null text is encoded as the empty one (begin and end id alone); a very
long text or word is encoded whole, memory follows the longest text; repeated rows
and ids give repeated rows; an empty table gives an empty result; all columns stay,
and an earlier column of the result's name is replaced.  Null ids decode to null.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks

MARK = "▁"
TABLE_WORDS = 400_000
BLOCK = 4 << 20
LONG_WORD = 256
MODEL_BYTES = 64 << 20
MARKED_WORD = re.compile(f"[ {MARK}]+[^ {MARK}]+(?:[ {MARK}]+\\Z)?|[ {MARK}]+\\Z")
UNEVEN = f"^ |  |{MARK}| $|^$"


def load_model(path: str) -> bytes:
    """The serialized model, bounded because every task gets it."""
    model = Path(path).read_bytes()
    if len(model) > MODEL_BYTES:
        raise ValueError(f"a tokenizer model has at most {MODEL_BYTES} bytes, {path} has {len(model)}")
    return model


def cuttable(model: bytes) -> bool:
    """Whether words can be segmented apart: BPE, text unchanged but for the marker before it, no piece across markers."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(model)
    spec = m.normalizer_spec
    return (m.trainer_spec.model_type == pb.TrainerSpec.BPE and not m.trainer_spec.treat_whitespace_as_suffix
            and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces and not m.denormalizer_spec.precompiled_charsmap
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces))


def marked_words(text: str) -> list[str]:
    """The marked words of a text that is not empty, each without its first marker."""
    return [w[1:] for w in MARKED_WORD.findall(" " + text)]


def words_of(texts: pa.Array, uneven: str = UNEVEN, cut=marked_words) -> tuple[pa.Array, np.ndarray]:
    """(the marked words of all texts, each text's first word with the total at the end).

    A text that ``uneven`` does not match is simply split at its spaces, the others by ``cut``.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    words = pc.split_pattern(texts, " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, uneven).to_numpy(zero_copy_only=False))
    if not len(odd):
        return words.flatten(), np.asarray(words.offsets) - words.offsets[0].as_py()
    own = [cut(t) if t else [] for t in texts.take(pa.array(odd)).to_pylist()]
    place = np.arange(len(texts))
    place[odd] = len(texts) + np.arange(len(odd))
    words = pa.concat_arrays([words, pa.array(own, words.type)]).take(pa.array(place))
    return words.flatten(), np.asarray(words.offsets) - words.offsets[0].as_py()


class Codec:
    """The model in a task, with its table of words; ids are little-endian 32-bit integers."""

    def __init__(self, model: bytes, cut: bool):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut, n = cut, self.lib.get_piece_size()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.lib.bos_id(), self.lib.eos_id()))
        self.control = np.array([self.lib.is_control(i) for i in range(n)], bool)
        self.marked = np.array([self.lib.id_to_piece(i).startswith(MARK) for i in range(n)], bool)
        letter = next(i for i in range(n) if not (self.marked[i] or self.control[i] or self.lib.is_byte(i) or self.lib.is_unknown(i)))
        self.surface = [t[len(self.lib.id_to_piece(letter)):] for t in self.lib.decode([[letter, i] for i in range(n)], num_threads=1)]
        self.high = np.array([self.lib.is_byte(i) and not self.surface[i].isascii() for i in range(n)], bool)
        self.words: dict[str, bytes] = {}
        self.byte_texts: dict[bytes, str] = {}
        self.segmented = 0

    def segment(self, words: list[str]) -> list[bytes]:
        """The library's ids of each word."""
        self.segmented += len(words)
        ids = self.lib.encode(words, num_threads=1)
        ends = (4 * np.cumsum([len(x) for x in ids])).tolist()
        flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4 if ends else 0).tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text with begin and end id."""
        if not self.cut:
            return [self.begin + x + self.end for x in self.segment([t or "" for t in texts.to_pylist()])]
        words, first = words_of(texts)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > TABLE_WORDS:
            self.words, new = {}, distinct
        fresh = dict(zip(new, self.segment(new)))
        ids = [fresh[w] if w in fresh else self.words[w] for w in distinct]
        self.words |= {w: x for w, x in fresh.items() if len(w) <= LONG_WORD}
        # the distinct words' ids behind each other, and from there to every place of a word
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.r_[0, np.cumsum(size)]
        n = size[which]
        ends = np.r_[0, np.cumsum(n)]
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[which] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[first].tolist()
        return [self.begin + flat[a:b].tobytes() + self.end for a, b in zip(at, at[1:])]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each array of ids, as the library's decode() has it."""
        if not self.cut:
            return self.lib.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
        out = []
        for raw in ids:
            x = np.frombuffer(raw, "<u4")
            texts = list(map(self.surface.__getitem__, x.tolist()))
            high = self.high[x]
            if high.any():       # a run of byte pieces is decoded as a whole, its text stands for the first of them
                edge = np.diff(np.r_[False, high, False].astype(np.int8))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    texts[a:b] = [self.byte_text(raw[4 * a:4 * b]), *[""] * (b - a - 1)]
            text = "".join(texts)
            seen = np.flatnonzero(~self.control[x])
            out.append(text[1:] if len(seen) and self.marked[x[seen[0]]] else text)
        return out

    def byte_text(self, run: bytes) -> str:
        if run not in self.byte_texts:
            if len(self.byte_texts) >= TABLE_WORDS:
                self.byte_texts.clear()
            self.byte_texts[run] = self.lib.decode(np.frombuffer(run, "<u4").tolist())
        return self.byte_texts[run]


def blocks(texts: pa.Array, size: int = BLOCK):
    """Slices of a column of texts of about ``size`` bytes, one text at least."""
    offs = np.r_[0, np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)))]
    for i, j in chunks(offs, size, len(texts)):
        yield texts[i:j]


def _codec(model: bytes):
    """A maker of the task's codec; the check of the model is done here, on the driver."""
    cut = cuttable(model)
    return lambda: Codec(model, cut)


def encode(docs: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``column`` (array of int): the ids of ``text`` with begin and end id."""
    out = docs.drop(column).withColumn(column, F.lit(None).cast(T.ArrayType(T.IntegerType())))
    make = _codec(model)

    def run(batches):
        codec = make()
        for b in batches:
            ids = [x for part in blocks(b.column(b.schema.names.index("text"))) for x in codec.encode(part)]
            offs = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offs, values)], b.schema.names)

    return out.mapInArrow(run, out.schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """All columns of ``df`` plus ``column``: the text of the column ``ids``; a null element of it is the unknown id."""
    out = df.drop(column).withColumn(column, F.lit(None).cast("string"))
    make = _codec(model)

    def run(batches):
        codec = make()
        unknown = codec.lib.unk_id()
        for b in batches:
            texts = []
            for x in b.column(b.schema.names.index(ids)):
                raw = None if not x.is_valid else np.asarray(x.values.fill_null(unknown)).astype("<u4").tobytes()
                texts.append(None if raw is None else codec.decode([raw])[0])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, b.schema.field(column).type)], b.schema.names)

    return out.mapInArrow(run, out.schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document: number of ids, digest of the ids, and of the text that they decode to.

    Encoding and decoding run in one pass, so the ids of the corpus leave no task.
    """
    make = _codec(model)

    def run(batches):
        codec = make()
        for b in batches:
            ids_of = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                      for part in blocks(b.column(1)) for ids in [codec.encode(part)] for x, t in zip(ids, codec.decode(ids))]
            n, ids_sha, text_sha = zip(*ids_of) if ids_of else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
