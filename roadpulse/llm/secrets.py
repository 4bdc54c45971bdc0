"""Secret scan (operator 10, native).

Base patterns find assignments, access keys and hex strings.  Two first-order
character Markov models, one of random strings (the secrets that the base
patterns find in a labelled sample) and one of ordinary identifiers (long words
of the same documents), give each further token a log-likelihood ratio; tokens
whose ratio exceeds a total and a per-character bound become ``markov`` spans.
Base spans always stay.

Training reads about ``TRAIN_DOCS`` documents at most, chosen by hash of doc_id; the
model is a table of ``len(ALPHABET)+1`` squared log ratios, so its size is fixed
and it travels as a literal.  Scanning is one projection: no shuffle, no Python.

Edge cases: null text counts as empty (no spans, hash of the empty string);
an empty table, or one without secrets in the sample, gives a model from the
smoothing alone, where no token passes; repeated rows are scanned each; extra
columns stay out of the result of the query; very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_sample, match_spans, span_text

# FIXED VALUES: the base patterns and their limits
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"   # AKIA[A-Z0-9]+ of 20 characters or more: the run is maximal either way
HEX = r"[0-9a-f]{24,}"          # likewise
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
N = len(ALPHABET) + 1            # 0: any other character
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
TRAIN_DOCS = 4000                # bound on the labelled sample
MIN_TOTAL = 12.0                 # least log-likelihood ratio (nats) of a whole token
MIN_PER_CHAR = 0.6               # and per character pair


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base patterns by kind."""
    assign = F.filter(match_spans(text, ASSIGN, "assign"),
                      lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return {"assign": assign, "access": match_spans(text, ACCESS, "access"), "hex": match_spans(text, HEX, "hex")}


def labelled_samples(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    """(token, secret): values found by the base patterns, and ordinary long words, of a bounded sample."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = bounded_sample(docs.select("doc_id", "text"), n_docs).select(text.alias("t"))
    value = F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: v)
    secret = F.concat(F.filter(value, lambda v: F.char_length(v) >= 16),
                      F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    # ordinary identifiers: words and plain numbers
    plain = F.filter(F.split("t", SPACES), lambda w: w.rlike(r"^([A-Za-z_-]{6,}|[0-9]{6,})[.,;:!?]*$"))
    both = F.concat(F.transform(secret, lambda v: F.struct(v.alias("token"), F.lit(True).alias("secret"))),
                    F.transform(plain, lambda v: F.struct(F.regexp_replace(v, "[.,;:!?]+$", "").alias("token"),
                                                          F.lit(False).alias("secret"))))
    return sample.select(F.inline(both))


def _pos(c: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """Log ratio random / ordinary per character pair, row-major over the alphabet (fixed size)."""
    pair = F.transform(F.sequence(F.lit(1), F.char_length("token") - 1),
                       lambda i: _pos(F.substr("token", i, F.lit(1))) * N + _pos(F.substr("token", i + 1, F.lit(1))))
    counts = (samples.filter(F.char_length("token") >= 2).select("secret", F.explode(pair).alias("k"))
              .groupBy("secret", "k").agg(F.count("*").alias("n")).collect())   # at most 2 N^2 rows
    tables = {True: [1.0] * (N * N), False: [1.0] * (N * N)}
    for r in counts:
        tables[r["secret"]][r["k"]] += r["n"]
    out = [0.0] * (N * N)
    for a in range(N):
        rows = {s: tables[s][a * N:(a + 1) * N] for s in tables}
        sums = {s: sum(v) for s, v in rows.items()}
        for b in range(N):
            out[a * N + b] = math.log(rows[True][b] / sums[True]) - math.log(rows[False][b] / sums[False])
    return out


def llr(token: Column, model: list[float]) -> Column:
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    # positions are looked up once per character, pairs from neighbouring positions
    at = F.transform(F.split(token, ""), lambda c: _pos(c))
    at = F.filter(at, lambda p: p >= 0)
    return F.aggregate(at, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
                       lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.when(
                           acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * N + p))).alias("sum")),
                       lambda acc: acc["sum"])


def markov_spans(text: Column, model: list[float], base: list[Column]) -> Column:
    """Tokens judged random that no base span overlaps."""
    taken = F.concat(*base)
    tokens = F.filter(match_spans(text, TOKEN, "markov"), lambda x: ~F.exists(
        taken, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    scored = F.transform(tokens, lambda x: F.struct(x.alias("x"), llr(x["found"], model).alias("r")))
    kept = F.filter(scored, lambda y: (y["r"] >= MIN_TOTAL) & (
        y["r"] >= MIN_PER_CHAR * (F.char_length(y["x"]["found"]) - 1)))
    return F.transform(kept, lambda y: y["x"])


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, one span array per kind (kind, s, e, found)."""
    model = train(labelled_samples(docs)) if model is None else model
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    base = base_spans(F.col("t"))
    d = d.select("doc_id", "t", *[c.alias(k) for k, c in base.items()])
    return d.select("doc_id", *base, markov_spans(F.col("t"), model, [F.col(k) for k in base]).alias("markov"))


def report(spans: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s spans."""
    base = F.concat("assign", "access", "hex")
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(base, KINDS), 256).alias("base_sha256"),
        span_text(F.concat(base, F.col("markov")), KINDS).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"))


MASK = "<SECRET>"


def mask(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span, base or added, replaced by ``MASK``; n_chars follows where it exists."""
    model = train(labelled_samples(docs)) if model is None else model
    t = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(t)
    d = docs.select("*", *[c.alias(f"__{k}") for k, c in base.items()])
    d = d.withColumn("__markov", markov_spans(t, model, [F.col(f"__{k}") for k in base]))
    spans = F.array_sort(F.transform(F.concat(*[F.col(f"__{k}") for k in KINDS]), lambda x: F.struct(x["s"], x["e"])))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def cut(acc, x):
        piece = F.concat(acc["out"], F.substr("text", acc["pos"] + 1, x["s"] - acc["pos"]), F.lit(MASK))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"),
                        F.when(x["s"] >= acc["pos"], piece).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(F.col("__spans"), start, cut, lambda acc: F.concat(
        acc["out"], F.substr("text", acc["pos"] + 1, F.char_length("text"))))
    d = d.withColumn("__spans", spans)
    hit = F.size("__spans") > 0
    new = {"text": F.when(hit, masked).otherwise(F.col("text"))}
    d = d.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns], hit.alias("__hit"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.col("__hit"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return d.select(docs.columns)
