"""Shared helpers of the training-data operators: shared-folder tables, word and span expressions.

Words are runs of characters other than U+0020 and U+0009 to U+000D.  Every
helper works on Column expressions, so it stays inside the JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The width the cluster gives a shuffle; partition counts of the operators follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<kind, s, e, found>> in code points.

    The pieces between the matches (``split``) and the matches themselves come
    from the same left-to-right search, so running lengths give the positions.
    """
    empty = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,found:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def step(acc, x):
        s = acc["pos"] + F.char_length(x["piece"])
        e = s + F.char_length(x["found"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["found"].alias("found"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found,
                      lambda p, f: F.struct(p.alias("piece"), f.alias("found")))
    got = F.aggregate(both, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), got).otherwise(empty)


def span_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` comma-joined, ordered by start, then kind as listed, then end."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.array_position(rank, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def bounded_sample(docs: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows of ``docs`` at most, chosen by a hash of all their columns.

    The share follows the row count, so no task or driver sees more than its part of
    the sample.  A hash of whole rows also parts rows of one doc_id or of none.  Equal
    rows share a hash: where they make the choice larger than twice the bound, which is
    counted, each counts once.
    """
    n = docs.count()
    share = min(1 << 30, -(-(bound << 30) // max(n, 1)))
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), *docs.columns), F.lit(1 << 30)) < share)
    return chosen.distinct() if chosen.count() > 2 * bound else chosen
