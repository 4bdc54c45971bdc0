"""Language identification (operator 5): word-first backoff.

A word seen in training scores by its log frequency in each language.  An unseen
word falls back to its character n-grams, the longest length first, and stops at
the first length with a known n-gram.  The scores of a text's words add up.

The n-grams hold the marks of a word's ends (``^``, ``$``); a mark alone is none.

How much of a text the model knows is told by ``matched``, the share of its
letters in known words, where an unseen word counts by its share of known
n-grams of length ``EVIDENCE``.  It does not depend on the number of languages.

Training is a Spark aggregation over at most about ``TRAIN_DOCS`` labelled rows;
the model is bounded by ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams a length,
so it may travel with the job.  Prediction is one Arrow-batched projection of the
text: no shuffle.

A word is a run of letters and combining marks that holds a letter, in training and
in prediction, so scripts whose vowels are marks keep their words whole; number
signs are no letters.  Words above 64 characters are not learned, and of words and
n-grams only those seen twice or more; prediction reads whole texts.

Edge cases: null text, or text without a letter, is ``und`` with score 0; text
without any known word or n-gram gets the first learned language with the score
of a tie; with nothing learned every text is ``und``; an empty table gives an
empty result; repeated rows are judged each; extra columns stay, those named like
an output are replaced; a text without a letter matches 0; very long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample

TRAIN_DOCS = 20_000
MAX_WORDS = 30_000
MAX_GRAMS = 10_000        # for each length
MAX_LANGS = 200
LENGTHS = (5, 4, 3, 2, 1)
EVIDENCE = 3              # n-gram length that tells known from unknown; letter junk is full of known 2-grams
MARK_ONLY = ("^", "$", "^$")
SMOOTH = 0.5
MEMO = 50_000             # unseen words remembered by a task
SURE = 8                  # words after which the score rests on the average word
LETTERS = r"[^\p{L}\p{M}]+"
WORD = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
# Without these, letters are what Python's word characters leave but for digits and '_': a faster search, the same words
PLAIN, MARKED = re.compile(r"[^\W\d_]+"), re.compile("[²³¹¼½¾\u0300-\U0010ffff]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _top(counts: DataFrame, key: str, langs: list[str], n: int) -> tuple[list[str], np.ndarray]:
    """The n most frequent keys and their counts by language; they reach the driver as Arrow columns."""
    by = counts.groupBy(key).agg(F.sum("n").alias("total"), *[
        F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)])
    got = by.filter("total > 1").orderBy(F.desc("total"), key).limit(n).drop("total").toArrow()
    return got.column(0).to_pylist(), np.array([c.to_numpy() for c in got.columns[1:]], float).T.reshape(len(got), len(langs))


def train(docs: DataFrame) -> dict:
    """Model from the labelled documents that are not held out: text and lang only."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(rows.select("doc_id", "text", "lang"), TRAIN_DOCS)
    word = F.explode(F.filter(F.split(F.lower("text"), LETTERS), lambda w: w.rlike(r"\p{L}")))
    counts = (sample.select("lang", word.alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
              .filter(F.char_length("w") <= 64).cache())
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n"))
                  .orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
        langs = sorted(totals)
        known = [("w", _top(counts, "w", langs, MAX_WORDS))]
        marked = F.concat(F.lit("^"), "w", F.lit("$"))
        for k in LENGTHS:
            grams = F.transform(F.sequence(F.lit(1), F.char_length(marked) - k + 1),
                                lambda i: F.substr(marked, i, F.lit(k)))  # noqa: B023
            grams = F.when(F.char_length(marked) >= k, grams)
            g = counts.select("lang", "n", F.explode(grams).alias("g")).filter(~F.col("g").isin(*MARK_ONLY))
            g = g.groupBy("lang", "g").agg(F.sum("n").alias("n"))
            known.append((k, _top(g, "g", langs, MAX_GRAMS)))
    finally:
        counts.unpersist()
    tables = {}
    for k, (names, c) in known:
        total = c.sum(axis=0) + SMOOTH * max(len(names), 1)
        tables[k] = (names, np.log((c + SMOOTH) / total).astype(np.float32))
    return {"langs": langs, "tables": tables}


class Scorer(dict):
    """word -> row of ``scores``; unseen words are scored by backoff and remembered."""

    def __init__(self, model: dict, evidence: bool = True):
        super().__init__()
        words, known = model["tables"]["w"]
        self.words = words
        self.update(zip(words, range(len(words))))
        self.n_known = len(words)
        self.n_langs = len(model["langs"])
        self.known = known
        self.grams = [(k, dict(zip(g, v))) for k, (g, v) in model["tables"].items() if k != "w"]
        self.new: list[np.ndarray] = []
        self.share: list[float] = []       # known n-grams of length EVIDENCE of each unseen word
        self.evident = dict(self.grams).get(EVIDENCE, {}) if evidence else None
        self.nothing = np.zeros(self.n_langs, np.float32)

    def __missing__(self, word: str) -> int:
        marked = f"^{word}$"
        score = self.nothing
        for k, table in self.grams:
            got = [v for i in range(len(marked) - k + 1) if (v := table.get(marked[i:i + k])) is not None]
            if got:
                score = sum(got) / len(got) if len(got) > 1 else got[0]
                break
        i = self.n_known + len(self.new)
        self.new.append(score)
        if self.evident is not None:
            own = [marked[i:i + EVIDENCE] for i in range(len(marked) - EVIDENCE + 1)]
            self.share.append(sum(g in self.evident for g in own) / len(own))
        if len(word) <= 64:
            self[word] = i
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def total(self, ids: np.ndarray) -> np.ndarray:
        seen = ids[ids < self.n_known]
        out = self.known[seen].sum(axis=0, dtype=np.float64) if len(seen) else np.zeros(self.n_langs)
        far = ids[ids >= self.n_known] - self.n_known
        for i in far.tolist():
            out = out + self.new[i]
        return out

    def matched(self, words: list[str], ids: np.ndarray) -> float:
        """Share of the letters in known words and n-grams."""
        letters = np.fromiter(map(len, words), np.int64, len(words))
        new = np.flatnonzero(ids >= self.n_known)
        lost = sum(int(letters[i]) * (1.0 - self.share[ids[i] - self.n_known]) for i in new.tolist())
        return float(1.0 - lost / letters.sum())

    def trim(self) -> None:
        """Forget the unseen words once there are more than MEMO."""
        if len(self.new) > MEMO:
            self.clear()
            self.update(zip(self.words, range(self.n_known)))
            self.new, self.share = [], []


def words_of(text: str) -> list[str]:
    """Runs of letters and marks that hold a letter, in lower case: the rule of the training."""
    low = text.lower()
    return PLAIN.findall(low) if MARKED.search(low) is None else WORD.findall(low)


def judge(text: str | None, scorer: Scorer, langs: list[str], evidence: bool = True) -> tuple[str, float, float]:
    """(language, score, share matched); the share is 0 without ``evidence``."""
    words = words_of(text) if text else []
    if not words or not langs:
        return "und", 0.0, 0.0
    ids = scorer.ids(words)
    total = scorer.total(ids)
    x = total / len(words) * min(len(words), SURE)
    x = np.exp(x - x.max())
    best = int(np.argmax(x))
    return langs[best], float(x[best] / x.sum()), scorer.matched(words, ids) if evidence else 0.0


def predict(text: str | None, scorer: Scorer, langs: list[str]) -> tuple[str, float]:
    return judge(text, scorer, langs, evidence=False)[:2]


def annotate(docs: DataFrame, model: dict, evidence: bool = False) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score, and with ``evidence`` also matched."""
    added = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]
    added += [("matched", T.DoubleType(), pa.float64())] if evidence else []
    names = [n for n, _, _ in added]
    kept = docs.select(*[c for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t, _ in added]])

    def run(batches):
        scorer, langs = Scorer(model, evidence), model["langs"]
        for b in batches:
            pred = []
            for t in b.column("text"):
                pred.append(judge(t.as_py(), scorer, langs, evidence))
                scorer.trim()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array([p[i] for p in pred], t) for i, (_, _, t) in enumerate(added)]],
                [*b.schema.names, *names])

    return kept.mapInArrow(run, schema)
