"""Document fingerprints (operator 8, native): threshold-scaled sketches.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash
space, so sketches of unequal documents stay comparable and the union of two
sketches is the sketch of the union.

Scale: documents are dealt into consecutive doc_id buckets (quantiles of doc_id,
a bounded array); the first document of each bucket is copied into the bucket
before it, so every document meets its successor inside one bucket and the text
moves once.  No window spans more than one bucket.

Edge cases: null text counts as empty; a null doc_id sorts before all others;
rows with equal doc_id are ordered by their text's hash; the only document is
its own successor; an empty table gives an empty result; a text with no shingle
below the threshold gets a digest of its words as fingerprint, alike (1.0) only
to texts with the same words.  Very long texts are cut into words whole, in one row's
array; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, words

SHINGLE = 5
SCALE = 4                 # one hash in SCALE is kept
BUCKETS_PER_PARTITION = 4
LOWEST = -(1 << 63)


def sketch_of_words(w: Column, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below the threshold; fewer than five words make one shingle."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                         lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
    got = F.when(n >= SHINGLE, hashes).when(n > 0, whole).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.array_sort(F.array_distinct(F.filter(got, lambda h: h < LOWEST + (1 << 64) // scale)))


def with_sketches(df: DataFrame, texts: dict[str, str], scale: int = SCALE) -> DataFrame:
    """Adds, for each ``text column -> name``, the sketch of that text.

    The words become columns first: an expression used inside a lambda would be
    evaluated anew for every shingle.
    """
    df = df.select("*", *[words(F.col(t)).alias(f"__w_{n}") for t, n in texts.items()])
    return df.select(*[c for c in df.columns if not c.startswith("__w_")],
                     *[sketch_of_words(F.col(f"__w_{n}"), scale).alias(n) for n in texts.values()])


def fingerprint(hashes: Column, text: Column) -> Column:
    """Printable form: 12 hex digits a hash, or a digest of the words when no hash is kept."""
    return F.when(F.size(hashes) > 0, F.concat_ws("", F.transform(
        hashes, lambda h: F.right(F.lpad(F.lower(F.hex(h)), F.lit(16), F.lit("0")), F.lit(12))))
    ).otherwise(F.concat(F.lit("w"), F.md5(F.concat_ws(" ", words(text)))))


def likeness(a: Column, fa: Column, b: Column, fb: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(fa == fb, 1.0).when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the key, by bisection."""
    if not bounds:
        return F.lit(0)
    arr = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << k for k in range(int(math.log2(len(bounds))), -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(
        (lo + s <= len(bounds)) & (F.get(arr, lo + s - 1) <= key), lo + s).otherwise(lo))


def with_next(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``docs`` (doc_id, t) plus ``next_t``: the text of the next document by id, cyclically."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(col), F.lit("")).alias("t"))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    n = BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    got = d.select(k.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(got or []))
    d = d.withColumn("k", k).withColumn("h", F.xxhash64("t")).withColumn("b", _bucket(F.col("k"), bounds))
    heads = {r["b"]: r["m"] for r in d.groupBy("b").agg(F.min(F.struct("k", "h")).alias("m")).collect()}  # a row a bucket
    if not heads:
        return d.select("doc_id", "t", F.lit("").alias("next_t"))
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    full = range(len(bounds) + 1)
    arr = lambda v: F.from_json(F.lit(str(v).replace("None", "null")), "array<bigint>")
    hk, hh = arr([heads[b]["k"] if b in heads else None for b in full]), arr([heads[b]["h"] if b in heads else None for b in full])
    is_head = (F.col("k") == F.get(hk, F.col("b"))) & (F.col("h") == F.get(hh, F.col("b")))
    real = F.struct(F.col("b").cast("int").alias("bucket"), F.lit(0).alias("extra"))
    copy = F.struct(F.get(arr([before.get(b) for b in full]), F.col("b")).cast("int").alias("bucket"), F.lit(1).alias("extra"))
    d = (d.withColumn("to", F.explode(F.when(is_head, F.array(real, copy)).otherwise(F.array(real))))
         .select("doc_id", "t", "k", "h", F.col("to.bucket").alias("bucket"), F.col("to.extra").alias("extra"))
         .repartition(shuffle_partitions(spark), "bucket"))
    w = Window.partitionBy("bucket").orderBy("extra", "k", "h")
    return d.withColumn("next_t", F.lead("t").over(w)).filter("extra = 0").select("doc_id", "t", "next_t")


def fingerprint_pairs(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each document with its sketch, its half-edited text's sketch and the next document's sketch."""
    d = with_next(docs)
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n", n).withColumn("edited", F.concat(
        F.substr("t", F.lit(1), n - half), F.substr("next_t", F.lit(1), half)))
    d = d.select("doc_id", F.col("n").cast("long").alias("n_chars"), "t", "edited", "next_t")
    return with_sketches(d, {"t": "sk", "edited": "sk_edited", "next_t": "sk_next"}, scale)


def report(pairs: DataFrame) -> DataFrame:
    p = pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sk", "sk_edited", "sk_next",
        fingerprint(F.col("sk"), F.col("t")).alias("fingerprint"),
        fingerprint(F.col("sk_edited"), F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("sk_next"), F.col("next_t")).alias("next_fingerprint"))
    return p.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("sk"), F.col("fingerprint"), F.col("sk_edited"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("sk"), F.col("fingerprint"), F.col("sk_next"), F.col("next_fingerprint")).alias("near_next"))
