"""Mixing sources to target weights (operator 7, native): iterative proportional fitting.

Documents fall into cells of (source, lang, topic).  Raking scales the cells'
token weights until the source, language and topic marginals meet their targets;
a document is then sampled with probability proportional to its cell's weight,
by a hash of doc_id, so the decision is stable.

Targets are shares.  Where none are given, a marginal's target is its share of
tokens raised to ``TEMPER`` and normalised, which lifts small sources and
languages.  The topic of a document is a coarse class of its text form.

Scale: one pass aggregates the corpus to cells (partial sums, so a hot source is
no hot task); the rounds run over the cell table only: up to ``DRIVER_CELLS`` cells as
arrays in the driver, beyond as joins and sums.  They end when the largest relative
error of a marginal is below ``TOLERANCE``, or when a round moves less than ``STILL``
of the weight: then no weights over the present cells meet all targets, and those
missed are logged and given by ``missed``.  The error may rise on the way (with three
marginals it is not monotone), so a round that does not lower it ends nothing.  The
weights come back to the documents by a join on the cell; Spark broadcasts the cell table only
under its size threshold and splits hot cells otherwise.

Edge cases: nulls in source, lang or text are values of their own (``?``, ``?``,
empty topic); blank texts weigh nothing and are never sampled; a null doc_id is
hashed as 0; repeated rows share their decision; a target for an absent value is
ignored and the others are normalised; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged

TEMPER = 0.7
TOLERANCE = 1e-4
STILL = 1e-12              # share of the weight that a round moves when the fit stands still
DRIVER_CELLS = 1 << 18     # cells that the driver fits as arrays
KEEP = 0.6                 # share of all tokens to sample
DIMS = ("m_source", "m_lang", "m_topic")
GRAIN = 1 << 40
log = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """Coarse class of the text's form."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    return (F.when(~t.rlike(r"[^\x20\x09-\x0D]"), "empty")
            .when(t.contains(" | "), "table")
            .when(t.contains("licensed under") | t.contains("Copyright"), "legal")
            .when(n < 600, "note").when(n < 6000, "article").otherwise("book"))


def tokens(text: Column) -> Column:
    """Number of words."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACES), "")).cast("long")


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` plus the marginals' values and the token weight."""
    return docs.withColumns({
        "m_source": F.coalesce(F.col("source").cast("string"), F.lit("?")),
        "m_lang": F.coalesce(F.col("lang").cast("string"), F.lit("?")),
        "m_topic": topic(F.col("text")), "m_tokens": tokens(F.col("text"))})


def targets(cells: DataFrame, dim: str, given: dict[str, float] | None = None) -> DataFrame:
    """(dim, target): shares that add up to one over the present values."""
    seen = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if given is None:
        seen = seen.withColumn("s", F.pow(F.col("t").cast("double"), F.lit(TEMPER)))
    else:
        goal = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.expr("map()")
        seen = seen.withColumn("s", F.coalesce(F.element_at(goal, F.col(dim)), F.lit(0.0)))
    total = seen.agg(F.sum("s").alias("all"))
    return seen.join(F.broadcast(total)).select(dim, F.when(F.col("all") > 0, F.col("s") / F.col("all")).otherwise(0.0).alias("target"))


def ended(off: float, moved: float) -> bool:
    """Whether the rounds are over: the targets are met, or the weights stand still."""
    return off < TOLERANCE or moved < STILL


def rake_arrays(weight: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The rounds over arrays; a side is (number of each cell's value, target of each value)."""
    while len(weight):
        before = weight
        for at, goal in sides:
            have = np.bincount(at, weight, len(goal))
            weight = weight * np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)[at]
        # after the last marginal was met, the first ones tell how far the fit is off
        off = max(np.max(np.abs(np.bincount(at, weight, len(goal)) - goal)[goal > 0] / goal[goal > 0], initial=0.0)
                  for at, goal in sides)
        if ended(off, np.abs(weight - before).sum()):
            break
    return weight


def rake_joins(c: DataFrame, dims: list[str]) -> DataFrame:
    """The rounds over a table with the targets as columns: a sum and a merge join per marginal."""
    while True:
        c = c.withColumn("before", F.col("weight"))
        for d in dims:
            have = c.groupBy(d).agg(F.sum("weight").alias("have"))
            ratio = F.when(F.col("have") > 0, F.col(f"goal_{d}") / F.col("have")).otherwise(0.0)
            c = c.join(have.hint("merge"), d).withColumn("weight", F.col("weight") * ratio).drop("have")
        c = staged(c, "mix-round")
        moved = c.agg(F.sum(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
        sums = [c.groupBy(d).agg(F.sum("weight").alias("have"), F.first(f"goal_{d}").alias("goal")).select("have", "goal")
                for d in dims]
        off = reduce(DataFrame.union, sums).filter("goal > 0").agg(
            F.max(F.abs(F.col("have") - F.col("goal")) / F.col("goal"))).first()[0] or 0.0
        c = c.drop("before")
        if ended(off, moved):
            return c


def missed(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """(dim, value, target, reached) of the targets that the raked weights do not meet."""
    out = [cells.groupBy(d).agg(F.sum("weight").alias("reached")).join(g, d)
           .select(F.lit(d).alias("dim"), F.col(d).alias("value"), "target", "reached") for d, g in goals.items()]
    return reduce(DataFrame.union, out).filter(F.abs(F.col("reached") - F.col("target")) >= F.col("target") * TOLERANCE).filter("target > 0")


def rake(cells: DataFrame, goals: dict[str, DataFrame], driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Adds ``weight`` to (m_source, m_lang, m_topic, tokens): shares that meet the targets."""
    total = cells.agg(F.sum("tokens").alias("all"))
    c = cells.join(F.broadcast(total)).withColumn("weight", F.col("tokens") / F.col("all")).drop("all")
    for d, g in goals.items():
        c = c.join(g.withColumnRenamed("target", f"goal_{d}").hint("merge"), d)
    c = staged(c, "mix-cells")
    if c.count() <= driver_cells:
        t = c.orderBy(*goals).toArrow()
        sides = []
        for d in goals:
            at = t[d].combine_chunks().dictionary_encode()
            goal = np.zeros(len(at.dictionary))
            goal[at.indices.to_numpy()] = t[f"goal_{d}"].to_numpy()
            sides.append((at.indices.to_numpy(), goal))
        fit = pa.array(rake_arrays(t["weight"].to_numpy(), sides), pa.float64())
        t = t.set_column(t.schema.get_field_index("weight"), "weight", fit).select([x for x in c.columns if not x.startswith("goal_")])
        c = staged(c.sparkSession.createDataFrame(t), "mix-fit")
    else:
        c = rake_joins(c, list(goals)).drop(*[f"goal_{d}" for d in goals])
    short = missed(c, goals).orderBy(F.desc(F.abs(F.col("reached") - F.col("target")) / F.col("target")), "dim", "value").limit(20).collect()
    if short:
        log.warning("targets not met (the worst): %s", "; ".join(f"{r.dim}={r.value}: {r.target:.6f}, reached {r.reached:.6f}" for r in short))
    return c


def weights(docs: DataFrame, source: dict | None = None, lang: dict | None = None, topics: dict | None = None) -> DataFrame:
    """Cell table with tokens, raked weight and the weight per token."""
    cells = (with_cells(docs).filter("m_tokens > 0").groupBy(*DIMS).agg(F.sum("m_tokens").alias("tokens"), F.count("*").alias("n_docs")))
    cells = staged(cells, "mix-corpus")
    goals = {d: targets(cells, d, given) for d, given in zip(DIMS, (source, lang, topics))}
    return rake(cells, goals).withColumn("per_token", F.col("weight") / F.col("tokens"))


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``probability``: min(1, scale * per_token), scaled so that the expected tokens are ``keep`` of all.

    The scale is found by filling: cells that reach probability 1 are fixed and
    the rest is scaled anew, until none is added.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, full = 0.0, None
    while True:
        capped = F.col("per_token") * F.lit(scale) >= 1 if full is not None else F.lit(False)
        r = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("t"),
                      F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w"),
                      F.sum(F.when(capped, 1).otherwise(0)).alias("n")).first()
        if not r["w"] or r["n"] == full:
            break
        full, scale = r["n"], max(scale, (keep * total - r["t"]) / r["w"])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("per_token") * F.lit(scale)))


def chance(doc_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on doc_id alone."""
    h = F.xxhash64(F.lit("mix"), F.coalesce(doc_id.cast("long"), F.lit(0)))
    return F.pmod(h, F.lit(GRAIN)) / F.lit(float(GRAIN))


def assign(docs: DataFrame, keep: float = KEEP, **given) -> DataFrame:
    """``docs`` plus m_source, m_lang, m_topic, m_tokens, weight (per token), probability and sampled."""
    cells = staged(calibrate(weights(docs, **given), keep), "mix-weights")
    d = with_cells(docs.drop("weight", "probability", "sampled"))
    d = d.join(cells.select(*DIMS, F.col("per_token").alias("weight"), "probability"), list(DIMS), "left")
    d = d.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))})
    return d.withColumn("sampled", (F.col("m_tokens") > 0) & (chance(F.col("doc_id")) < F.col("probability")))


def sample(docs: DataFrame, keep: float = KEEP, **given) -> DataFrame:
    """The sampled documents, columns as they were."""
    return assign(docs, keep, **given).filter("sampled").select(docs.columns)
