"""Packed exchanges: tasks trade sorted key arrays, one row per (part, bucket).

Documents are dealt once into parts by a hash of the row.  A part tells each
key bucket its distinct keys (so a key that a third of all documents hold counts
once per part), the bucket answers each part, and the part meets the answer in a
cogroup with its documents, whose exchange Spark reuses.  Every step is a Spark
shuffle of rows with binary payloads; nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import column
from .common import shuffle_partitions

MESSAGE = "part int, bucket int, keys binary, extra binary"
PARTS_PER_PARTITION = 2


def dealt(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text): rows dealt by a hash of the whole row; null text becomes empty."""
    n = PARTS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = F.col("doc_id").cast("long")
    return docs.select(F.pmod(F.xxhash64(d, t), F.lit(n)).cast("int").alias("part"), d.alias("doc_id"), t.alias("text"))


def message(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    """Rows (bucket, keys, extra) of one part."""
    return pa.table({
        "part": pa.array([part] * len(rows), pa.int32()),
        "bucket": pa.array([r[0] for r in rows], pa.int32()),
        "keys": pa.array([r[1] for r in rows], pa.binary()),
        "extra": pa.array([r[2] for r in rows], pa.binary())})


def part_of(table: pa.Table) -> int:
    return table.column("part")[0].as_py()


def arrays_of(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column(table, name)]


def ask(parts: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return parts.groupBy("part").applyInArrow(fn, MESSAGE)


def answer(messages: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return messages.groupBy("bucket").applyInArrow(fn, MESSAGE)


def meet(parts: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(fn, schema)


# -- which keys occur more than once -------------------------------------------------

def key_codes(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """bucket << 32 | 32 further bits of the hash; a clash only costs work, never a result."""
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def split_codes(codes: np.ndarray, n_buckets: int):
    """(bucket, slice) for each bucket that has codes, ascending codes given."""
    b = np.searchsorted(codes, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))
    return [(i, slice(int(b[i]), int(b[i + 1]))) for i in range(n_buckets) if b[i] < b[i + 1]]


def count_request(part: int, codes: np.ndarray, n_buckets: int) -> pa.Table:
    """Ask how often each of the part's codes occurs over all parts."""
    u, c = np.unique(codes, return_counts=True)
    c = np.minimum(c, 65535).astype(np.uint16)
    return message(part, [(i, (u[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), c[s].tobytes())
                          for i, s in split_codes(u, n_buckets)])


def count_answer(table: pa.Table) -> pa.Table:
    """For each asking part, the total counts (capped at 65535) in the order of its keys."""
    keys, counts = arrays_of(table, "keys", np.uint32), arrays_of(table, "extra", np.uint16)
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    ks = k[order]
    at = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)
    out = np.empty(len(k), np.uint16)
    out[order] = np.minimum(np.repeat(total, np.diff(np.r_[at, len(ks)])), 65535)
    ends = np.cumsum([len(x) for x in keys])
    return pa.table({"part": column(table, "part"), "bucket": column(table, "bucket"),
                     "keys": pa.nulls(len(table), pa.binary()),
                     "extra": pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())})


def counts_of(answers: pa.Table, codes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes of the part, their total counts) from the answers to ``count_request``."""
    u = np.sort(codes)      # np.unique hashes integers that it does not count, at several times the cost
    u = u[np.r_[True, u[1:] != u[:-1]]] if len(u) else u
    return u, _answered(answers, u, n_buckets)


def counts_at(answers: pa.Table, codes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The total count of each of the part's codes, in their order."""
    order = np.argsort(codes)
    u = codes[order]
    head = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
    out = np.empty(len(codes), np.uint16)
    out[order] = _answered(answers, u[head], n_buckets)[np.cumsum(head) - 1]
    return out


def _answered(answers: pa.Table, u: np.ndarray, n_buckets: int) -> np.ndarray:
    got = np.ones(len(u), np.uint16)
    by = dict(zip(answers.column("bucket").to_pylist(), arrays_of(answers, "extra", np.uint16)))
    for i, s in split_codes(u, n_buckets):
        got[s] = by[i]
    return got
