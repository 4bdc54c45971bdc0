"""Operators 12 and 13 against the libraries and plain searches over whole texts."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import pieces, token_align
from roadpulse.llm.queries import QUERIES, _vocabulary

from .conftest import make

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(_vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pair():
    return token_align.load_pair(_vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def library(model):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = " ▁  \n\t\r\x0b\x1c\x85\xa0 ​﻿ab<s>é漢😀.,\x00'st12 "
    own = ["", " ", "  ", "a ", " a", "a  ", "<s>", "</s> a", "▁", "a▁", "▁ a", "x" * 3000, "a\n b", "a \nb", "don't  stop", "<|endoftext|> x",
           "हिन्दी में", "日本語のテキスト 漢字", "a᠎ b ᠎b"]
    return own + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encode_and_decode_as_the_library(model):
    codec, lib = pieces.Codec(model, pieces.cuttable(model)), library(model)
    assert codec.cut
    texts = odd_texts(3000, 1)
    ids = codec.encode(pa.array(texts))
    for t, x, d in zip(texts, ids, codec.decode(ids)):
        want = [lib.bos_id(), *lib.encode(t), lib.eos_id()]
        assert np.frombuffer(x, "<u4").tolist() == want, t
        assert d == lib.decode(want), t


def test_decode_any_ids(model):
    codec, lib, rng = pieces.Codec(model, True), library(model), random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, 3, 10, 200, 232, 259, 264, 2287, 28705, rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode([np.array(ids, "<u4").tobytes()]) == [lib.decode(ids)], ids


def test_models_that_cannot_be_cut_get_whole_texts(model):
    a, b = pieces.Codec(model, True), pieces.Codec(model, False)
    texts = pa.array([*odd_texts(200, 3), None])
    assert a.encode(texts) == b.encode(texts)
    assert a.decode(a.encode(texts)) == b.decode(a.encode(texts))


def test_words_are_segmented_once(model):
    codec = pieces.Codec(model, True)
    codec.encode(pa.array(["one two three"] * 50 + ["two three four"] * 50))
    codec.encode(pa.array(["four  one", "two"]))
    assert codec.segmented == 4 + 1      # "four" and " one" are a word and a word behind two markers


def test_full_tables_start_anew(model, monkeypatch):
    texts = pa.array(odd_texts(300, 5))
    want = pieces.Codec(model, True).encode(texts)
    monkeypatch.setattr(pieces, "TABLE_WORDS", 20)
    codec = pieces.Codec(model, True)
    assert [x for i in range(0, len(texts), 7) for x in codec.encode(texts[i:i + 7])] == want


def test_sentencepiece_query(spark, model):
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, SF0001).collect()}
    lib = library(model)
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect():
        ids = [lib.bos_id(), *lib.encode(r.text or ""), lib.eos_id()]
        x = got.pop(r.doc_id)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert not got


def test_sentencepiece_tables(spark, docs, empty, model):
    lib = library(model)
    out = pieces.decode(pieces.encode(docs.withColumn("ids", F.lit("taken")).withColumn("decoded", F.lit(1)), model), model)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == [lib.bos_id(), *lib.encode(r.text or ""), lib.eos_id()] and r.decoded == lib.decode(r.ids)
    assert pieces.round_trip(empty, model).collect() == [] and pieces.encode(empty, model).collect() == []
    lists = spark.createDataFrame([(1, [None, 264]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decode(lists, model).orderBy("k").collect()] == [lib.decode([0, 264]), None, ""]


# -- alignment -------------------------------------------------------------------------

def plain(texts: list, pair) -> list[tuple]:
    """The contract of operator 13, token by token over whole texts."""
    from tokenizers import Tokenizer
    tok, whole = token_align.Tokens(*pair), Tokenizer.from_file(_vocabulary("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    docs, links = [], Counter()
    for t in texts:
        found = []
        if t:
            ids = whole.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)
            spelled = [[s[i] for i in x] for x, s in zip(ids, (tok.a_bytes, tok.b_bytes))]
            if all(b"".join(s) == (" " + t).encode() for s in spelled):
                sides = []
                for x, s in zip(ids, spelled):
                    at, side = 0, []
                    for i, b in zip(x, s):
                        side.append((i, at, at + len(b)))
                        at += len(b)
                    sides.append(side)
                found = sides
        if not found:
            docs.append((0, 0, 0, [], ""))
            continue
        a, b = found
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        a_end, b_end = [x[2] for x in a], [x[2] for x in b]
        groups, p, q = [], 0, 0
        for e in ends:
            i, j = bisect_right(a_end, e), bisect_right(b_end, e)
            groups.append(",".join(str(x[0]) for x in a[p:i]) + "|" + ",".join(str(x[0]) for x in b[q:j]))
            p, q = i, j
        own = [(x[0], y[0]) for x in a for y in b[bisect_right(b_end, x[1]):bisect_right(b_end, x[2]) + 1] if x[1] < y[2] and y[1] < x[2]]
        links.update(own)
        docs.append((len(a), len(b), len(groups), own, ";".join(groups)))
    top = Counter()
    for (x, y), n in links.items():
        top[y] = max(top[y], n)
    return [(na, nb, ng, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, own, g in docs]


def answers(rows) -> list[tuple]:
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


ALIGN = odd_texts(400, 4)


def test_alignment_against_plain_search(spark, pair):
    texts = [*ALIGN, None, "same text here", "same text here"]
    df = make(spark, list(enumerate(texts)))
    got = token_align.align(df.withColumn("unit", F.lit(1)).withColumn("pairs", F.lit("x")), *pair).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert answers(got) == plain(texts, pair)


def test_long_documents_by_ranges(spark, pair, monkeypatch):
    """Every document of more than 40 bytes in ranges of about 16 characters, three neighbours a round."""
    monkeypatch.setattr(token_align, "LONG_BYTES", 40)
    monkeypatch.setattr(token_align, "RANGE_CHARS", 16)
    monkeypatch.setattr(token_align, "FAN_IN", 3)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(ALIGN) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [t.replace("▁", "") if i % 3 else t for i, t in enumerate(texts)]
    texts += ["a  b   c \n d " * 20, "漢字かな" * 40, "unbelievable, straightforwardness " * 30, None, ""]
    got = token_align.align(make(spark, list(enumerate(texts))), *pair).orderBy("doc_id").collect()
    assert answers(got) == plain(texts, pair)


def test_composition_is_associative(pair, monkeypatch):
    monkeypatch.setattr(token_align, "RANGE_CHARS", 7)
    tok, rng = token_align.Tokens(*pair), random.Random(9)

    def same(x, y):
        return all(np.array_equal(p, q) for p, q in zip(x, y))

    open_ends = 0
    for _ in range(60):
        text = "".join(rng.choice(["un", "believ", "able ", "  ", "\n", "é", "漢", "don't ", "12 ", ", "]) for _ in range(40))
        parts = [tok.range_fragment(t, at, *p) for at, *p, t in token_align.ranges_of(text)]
        open_ends += sum(f.a_suffix.size > 0 for f in parts)
        left = right = parts[0]
        for f in parts[1:]:
            left = token_align.compose(left, f)
        right = parts[-1]
        for f in parts[-2::-1]:
            right = token_align.compose(f, right)
        assert same(left, right) and same(left, token_align.composed(parts))
        assert same(token_align.compose(token_align.Fragment(), left), left) and same(token_align.compose(left, token_align.Fragment()), left)
        whole = token_align.whole_text(left)
        ok, groups, n_a, pairs, counts = tok.documents(pa.array([text]))[0]
        assert ok and whole.groups == groups and whole.n_a == n_a and not whole.a_suffix.size
        assert np.array_equal(whole.pairs, pairs) and np.array_equal(whole.counts, counts)
    assert open_ends


def test_alignment_of_awkward_tables(spark, docs, empty, pair):
    assert token_align.align(empty, *pair).collect() == []
    rows = docs.orderBy("doc_id", "text").collect()
    got = token_align.align(docs, *pair).collect()
    want = plain([r.text for r in rows], pair)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, *a) for r, a in zip(got, answers(got))), key=key) == sorted(((r.doc_id, *a) for r, a in zip(rows, want)), key=key)


def test_alignment_query(spark, pair):
    got = QUERIES["op13_token_alignment"](spark, SF0001).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert answers(got) == plain([r.text for r in rows], pair)
