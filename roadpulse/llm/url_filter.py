"""URL filter by a Bloom filter cascade (operator 3, native).

The listed keys are encoded in a Bloom filter; the keys of the corpus that it
wrongly accepts in a second one; the listed keys that the second wrongly accepts
in a third, and so on until no key is wrongly accepted.  Because the false
positives are taken over the *complete* key universe of the corpus, membership
of every corpus key is exact, and a lookup is a bit test per level: no join with
the list.  A key is the host plus the leading path directories that rules can
tell apart.

Scale: the universe is a partially aggregated ``distinct``; a level is a
``bit_or`` per 64-bit word.  The cascade has a computed size: while it is at most
``max_literal_words`` it travels as a literal in the plan, beyond that it is cut
into shards by key hash and reached by an equi-join on the shard.

Edge cases: null url or one without ``://`` has empty host and path, no rule and
verdict ``allow``; an empty table gives an empty result; repeated rows are judged
each; extra columns stay, those named like an output are replaced; very long urls are
judged whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

# FIXED VALUES: the rules to judge by, (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Site labels whose hosts are listed for urls that no rule decides.
LISTED_LABELS = ["spam-farm", "cheap-pills"]
HASHES = 3            # bits set per key and level
BITS_PER_KEY = 6      # 3 bits set per key: about 6 % false positives
MAX_LITERAL_WORDS = 1 << 17   # 1 MB of filter words
SHARD_KEYS = 1 << 16  # listed keys per shard once sharded


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule, host: Column, path: Column) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def first_rule(rules, host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        c = fits(r, host, path)
        out = F.when(c, F.lit(value(r))) if out is None else out.when(c, F.lit(value(r)))
    return out if out is not None else F.lit(None).cast("string")


def key_path(path: Column, rules) -> Column:
    """Leading directories of the path, as deep as the deepest rule."""
    depth = max([r[1].count("/") - 1 for r in rules] + [0])
    return F.regexp_extract(path, rf"^(?:/[^/]*){{0,{depth}}}/", 0)


def _bit(key: Column, level: int, i: int, n_words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), n_words * 64)


def _accepts(key: Column, words: Column, level: int) -> Column:
    """Does the filter in ``words`` (array<bigint>) accept the key?  An empty filter accepts nothing."""
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    hit = F.lit(True)
    for i in range(HASHES):
        pos = _bit(key, level, i, n)
        word = F.get(words, F.shiftright(pos, 6).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(pos, F.lit(64))) == 1)
    return F.coalesce(hit, F.lit(False))


def _level(keys: DataFrame, level: int) -> DataFrame:
    """(shard, words): the Bloom filter over ``keys`` (shard, key), sized per shard by its key count."""
    sized = keys.groupBy("shard").agg(F.count("*").alias("n"))
    sized = sized.withColumn("n_words", F.ceil(F.col("n") * BITS_PER_KEY / 64).cast("long"))
    pos = F.array(*[_bit(F.col("key"), level, i, F.col("n_words")) for i in range(HASHES)])
    bits = (keys.join(sized, "shard").select("shard", "n_words", F.explode(pos).alias("p"))
            .groupBy("shard", "n_words", F.shiftright("p", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64L) as int))")).alias("v")))
    per = bits.groupBy("shard", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return per.select("shard", F.expr(
        "transform(sequence(0, cast(n_words as int) - 1), i -> coalesce(m[i], 0L))").alias("words"))


def words_for(n_keys: int) -> int:
    """64-bit words of a filter over so many keys."""
    return math.ceil(n_keys * BITS_PER_KEY / 64)


def build_cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS, max_words: int = MAX_LITERAL_WORDS, n_shards: int = 0):
    """Cascade over ``universe`` (key, listed).

    Returns ``(levels, n_shards, table)``: ``levels`` are Python lists of words
    per level when the whole cascade is small (one shard), else ``None`` and
    ``table`` holds (shard, f0, f1, ...).
    """
    if not n_shards:
        n_listed = universe.agg(F.count(F.when(F.col("listed"), 1))).first()[0]
        n_shards = 1 if words_for(n_listed) <= max_words else max(2, math.ceil(n_listed / shard_keys))
    u = staged(universe.withColumn("shard", F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(n_shards)).cast("int")),
               "urls-universe")
    inside = u.filter("listed").select("shard", "key")          # what the next level encodes
    outside = u.filter("not listed").select("shard", "key")     # what it must not accept
    levels, tables, level = [], [], 0
    while True:
        # a level encodes what the one before wrongly accepts of the universe, so each is measured before it is built
        if n_shards == 1 and (n := inside.count()) and words_for(n) + sum(map(len, levels)) > max_words:
            return build_cascade(universe, shard_keys, max_words, max(2, math.ceil(n / shard_keys)))
        f = staged(_level(inside, level), f"urls-level{level}")
        tables.append(f)
        if n_shards == 1:
            row = f.first()
            levels.append(list(row["words"]) if row else [])
        wrong = staged(_probe(outside, f, levels[-1] if n_shards == 1 else None, level), f"urls-wrong{level}")
        if wrong.isEmpty():
            break
        inside, outside, level = wrong, inside, level + 1
    if n_shards == 1:
        return levels, 1, None
    table = None
    for i, f in enumerate(tables):
        f = f.withColumnRenamed("words", f"f{i}")
        table = f if table is None else table.join(f, "shard", "full")
    return None, n_shards, table


def _words_lit(words: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")


def _probe(keys: DataFrame, f: DataFrame, words: list[int] | None, level: int) -> DataFrame:
    """The keys that the level accepts."""
    if words is not None:
        return keys.filter(_accepts(F.col("key"), _words_lit(words), level))
    return keys.join(f, "shard").filter(_accepts(F.col("key"), F.col("words"), level)).select("shard", "key")


def _member(key: Column, filters: list[Column]) -> Column:
    """Exact membership: the first level that refuses the key decides, else the last level's side."""
    out = None
    for i, words in enumerate(filters):
        c, v = ~_accepts(key, words, i), F.lit(i % 2 == 1)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(F.lit((len(filters) - 1) % 2 == 0))


def judge_urls(pages: DataFrame, rules=RULES, labels=LISTED_LABELS, url_col: str = "url",
               shard_keys: int = SHARD_KEYS, max_words: int = MAX_LITERAL_WORDS) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; the verdict is the cascade's answer for every row.

    A key is listed when the longest rule that fits says block, or when no rule
    fits and one of the host's labels is on the list.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    cols = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    p = pages.select(*cols, host.alias("host"), path.alias("path"))
    p = p.withColumn("__key", F.concat("host", key_path(F.col("path"), rules)))
    uni = p.groupBy("__key").agg(F.first("host").alias("h"), F.first(key_path(F.col("path"), rules)).alias("d"))
    label = F.arrays_overlap(F.split("h", r"\."), F.array(*[F.lit(x) for x in labels])) if labels else F.lit(False)
    by_rule = first_rule(rules, F.col("h"), F.col("d"), lambda r: r[2])
    uni = uni.select(F.col("__key").alias("key"),
                     F.when(by_rule.isNotNull(), by_rule == "block").otherwise(label).alias("listed"))
    levels, n_shards, table = build_cascade(uni, shard_keys, max_words)
    if table is None:
        listed = _member(F.col("__key"), [_words_lit(w) for w in levels])
    else:
        p = p.withColumn("__shard", F.pmod(F.xxhash64(F.lit(-1), "__key"), F.lit(n_shards)).cast("int"))
        table = table.toDF(*[f"__{c}" for c in table.columns])
        p = p.join(table, "__shard", "left")
        filters = [c for c in table.columns if c != "__shard"]
        # a shard without a level ends there: an empty filter accepts nothing
        listed = _member(F.col("__key"), [F.coalesce(F.col(c), F.expr("cast(array() as array<bigint>)")) for c in filters])
    rule = first_rule(rules, F.col("host"), F.col("path"), lambda r: r[0] + r[1])
    return p.select(*cols, "host", "path", rule.alias("rule"),
                    F.when(listed, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
