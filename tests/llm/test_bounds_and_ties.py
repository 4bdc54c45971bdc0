"""Edited items of every length, rows of repeated or null ids, bounds that bind, scripts with marks, long words."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import decontaminate, jaccard_join, langid, pii, url_filter
from roadpulse.llm.common import bounded_sample

from .conftest import make


@pytest.mark.parametrize("n", [30, 60, 160, 320, 500])
def test_decontamination_recall_at_the_edit_limit(n):
    """Items of every length are found in texts that differ by the full 25 % of word edits."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(words) for _ in range(n)] for _ in range(30)]

    def edited(item):
        w = list(item)
        for _ in range(n * decontaminate.EDIT_PERCENT // 100):
            i = rng.randrange(len(w))
            w[i:i + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(words)], [rng.choice(words)]])
        return w

    noise = lambda: [rng.choice(words) for _ in range(40)]
    block = decontaminate.Items(list(range(30)), [" ".join(x) for x in items])
    h, first = decontaminate.words_of(pa.array([" ".join(noise() + edited(x) + noise()) for x in items]))
    found = {(d, i) for d, i, *_ in block.leaks(h, first)}
    assert sum((i, i) in found for i in range(30)) >= 30 * decontaminate.TARGET


A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
B = "one two three four five six seven eight nine ten eleven twelve thirteen"


def kept(spark, rows):
    d = make(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(("__rows", "__h", "__n", "__own", "__key", "d", "root", "sig"))})
    out = jaccard_join.keep_one(d)
    assert out.columns == d.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def plain_keep(rows):
    """One row of each component: the smallest id, a null one last; rows without words stay."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else (i, "own"), []).append(rows[i])
    return [{r for r in g if (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in g)} for g in groups.values()]


CASES = [
    [(1, A), (2, A), (2, B), (None, A), (3, A + " x"), (3, A)],
    [(1, A), (1, A + " tail"), (2, B)],
    [(None, A), (None, A), (None, A + " tail"), (None, B), (None, None), (None, "")],
    [(5, A), (5, A), (5, B), (4, B), (4, B + " more")],
    [(1, None), (1, ""), (2, None), (3, " \t")],
    [(7, A), (8, B), (9, "short text")],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_keep_one_row_of_each_component(spark, case):
    rows = CASES[case]
    got, want = kept(spark, rows), plain_keep(rows)
    assert len(got) == len(want)
    for group in want:
        assert any(r in [tuple(x) for x in group] for r in got)


def test_bounded_samples_bind(spark):
    hot = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    none = hot.withColumn("doc_id", F.lit(None).cast("long"))
    equal = hot.withColumn("text", F.lit("same"))
    for d, least in ((hot, 20), (none, 20), (equal, 0)):
        assert least <= bounded_sample(d, 50).count() <= 100
    assert bounded_sample(hot.limit(30), 50).count() == 30 and bounded_sample(hot.limit(0), 50).count() == 0


def test_cascade_measures_every_level(spark):
    """A level of false positives that exceeds the literal's bound is sharded, with the same answers."""
    universe = spark.range(40_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 400 == 0).alias("listed"))
    levels, n_shards, table = url_filter.build_cascade(universe, shard_keys=50, max_words=60)
    assert levels is None and n_shards > 1 and table is not None
    small, one, _ = url_filter.build_cascade(universe, max_words=100_000)
    assert one == 1 and sum(map(len, small)) > 60
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x"), F.col("id") % 700, F.when(
        F.col("id") % 90 == 0, ".spam-farm").otherwise(".site"), F.lit(".info/a")).alias("url"))
    pages = pages.withColumn("shard", F.lit("own")).withColumn("f0", F.lit(1))
    a, b = url_filter.judge_urls(pages), url_filter.judge_urls(pages, shard_keys=3, max_words=1)
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())
    assert b.filter("shard <> 'own'").isEmpty() and b.filter("verdict = 'block'").count() == a.filter("url like '%spam-farm%'").count()


SCRIPTS = {"hi": "हिन्दी में किताब पढ़ना बहुत अच्छा है", "th": "ภาษาไทยนี้ดีมากที่สุด", "ar": "العَرَبِيَّةُ لُغَةٌ جَمِيلَةٌ جِدًّا",
           "vi": "tiếng Việt rất hay"}


def test_scripts_with_marks_keep_their_words(spark):
    rows = [(i, t, lang) for lang, t in SCRIPTS.items() for i in range(40)]
    rows = [(n, t, lang, "s") for n, (_, t, lang) in enumerate(rows)]
    rows += [(1000 + n, t, None, "s") for n, t in enumerate(["½ ② ① Ⅷ", "12 345", "·:! ́", "²", None, "", *SCRIPTS.values()])]
    docs = make(spark, rows)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.annotate(docs, model, evidence=True).collect()}
    assert {(got[1000 + i].lang_pred, got[1000 + i].score) for i in range(6)} == {("und", 0.0)}
    for i, (lang, t) in enumerate(SCRIPTS.items()):
        assert got[1006 + i].lang_pred == lang and got[1006 + i].matched >= 0.9, (t, got[1006 + i])
    assert langid.words_of("Été x² a_b") == ["été", "x", "a", "b"]


def test_both_word_rules_agree():
    rng = random.Random(1)
    letters = [chr(i) for i in [*range(32, 0x300)]]
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(40)).lower()
        if langid.MARKED.search(t) is None:
            assert langid.PLAIN.findall(t) == langid.WORD.findall(t), t


def test_language_scores_against_a_plain_scorer(docs):
    """Every document's prediction, by the model's tables alone."""
    import numpy as np
    model = langid.train(docs)
    langs, tables = model["langs"], {k: dict(zip(g, v)) for k, (g, v) in model["tables"].items()}

    def plain(text):
        words = langid.WORD.findall((text or "").lower())
        if not words:
            return "und", 0.0
        total = np.zeros(len(langs))
        for w in words:
            score = tables["w"].get(w)
            for k in langid.LENGTHS:
                if score is not None:
                    break
                m = f"^{w}$"
                hits = [tables[k][m[i:i + k]] for i in range(len(m) - k + 1) if m[i:i + k] in tables[k]]
                score = sum(hits) / len(hits) if hits else None
            total += 0 if score is None else score
        x = np.exp((y := total / len(words) * min(len(words), langid.SURE)) - y.max())
        return langs[int(np.argmax(x))], float(x.max() / x.sum())

    for r in langid.annotate(docs, model).collect():
        lang, score = plain(r.text)
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or score < 0.51), r.doc_id


def test_shapes_see_the_whole_word():
    assert "@" in pii.shape("111-" + "x" * 70 + "@b.co")
    assert pii.shape("+1234567") == "+9999" and pii.shape("Abc-9") == "Aa-9"
    assert len(pii.shape("a1" * 10_000 + "@")) <= pii.SHAPE + 3
