"""The language stage rejects by what the model knows of a text, whatever the number of languages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.conftest import make
from roadpulse.llm import langid

SF = "/root/testdata/sf0.001"
CLEAN = ["Der Hund schläft.", "She reads a book", "Le chat dort ici", "El perro come", "Guten Tag", "That it.", "Von."]
STRANGE = ["一二三四 五六七八 天地玄黄 宇宙洪荒 日月盈昃 辰宿列张 寒来暑往 秋收冬藏 闰余成岁 律吕调阳", "漢字",
           "Все люди рождаются свободными и равными в своем достоинстве и правах",
           "Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice"]


def junk(rnd, letters):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 9))) for _ in range(12))


@pytest.mark.parametrize("langs", [["en", "de", "fr", "es"], ["en", "de"], ["en"]])
def test_unknown_texts_go_and_short_clean_texts_stay(spark, langs):
    rnd = random.Random(3)
    bad = STRANGE + [junk(rnd, s) for s in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for _ in range(20)]
    good = CLEAN if len(langs) == 4 else ["She reads a book", "That it."]
    rows = [(10_000 + i, t, None) for i, t in enumerate(bad)] + [(20_000 + i, t, None) for i, t in enumerate(good)]
    d = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("lang").isin(langs))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d.union(make(spark, [(*r, "s") for r in rows])), SF).collect()}
    assert not [bad[i - 10_000] for i in kept if 10_000 <= i < 20_000]
    assert not [t for i, t in enumerate(good) if 20_000 + i not in kept]
    assert d.filter(~F.col("doc_id").isin(list(kept))).count() == 0


def test_marks_of_a_words_ends_are_no_evidence(docs):
    model = langid.train(docs)
    assert not set(langid.MARK_ONLY) & set(model["tables"][1][0])
    name, score, matched = langid.judge("一二三四 五六七八", langid.Scorer(model), model["langs"])
    assert abs(score - 1 / len(model["langs"])) < 1e-6 and matched == 0.0
    assert langid.judge("", langid.Scorer(model), model["langs"]) == ("und", 0.0, 0.0)
