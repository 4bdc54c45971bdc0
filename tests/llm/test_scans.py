"""URL filter, language ID, personal data, secrets and fingerprints against plain Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from llm.conftest import make
from roadpulse.llm import langid, pii, secrets, sketch, url_filter

SF = "/root/testdata/sf0.001"


# -- URL filter -----------------------------------------------------------------------

def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fit, key=lambda r: len(r[0] + r[1])) if fit else None
    block = rule[2] == "block" if rule else bool(set(host.split(".")) & set(url_filter.LISTED_LABELS))
    return host, path, rule and rule[0] + rule[1], "block" if block else "allow"


def test_url_filter_is_exact(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "http://NET/x", "http://a.net", "http://a.net/", "http://anet/", "x://b.org/fr",
             "x://b.org/fr/", "HTTP://Spam-Farm.example.org?x", "a://b://c.example.com/de/y#z", "http://example.com/de/\n?q", "x" * 50_000]
    urls += [f"http://h{i}.site{i % 7}.{t}/{p}/{i}" for i in range(300) for t, p in (("net", "a"), ("org", "fr"), ("org", "de"))]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    want = {i: judge(u) for i, u in enumerate(urls)}
    for sizes in ({}, {"shard_keys": 8, "max_words": 0}):      # literal cascade, sharded cascade
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, **sizes).collect()}
        assert got == want
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# -- language ID ----------------------------------------------------------------------

def test_language_id(docs, empty):
    model = langid.train(docs)
    rows = langid.annotate(docs.withColumn("score", F.lit("clash")), model).collect()
    named = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert named and sum(r.lang == r.lang_pred for r in named) >= 0.95 * len(named)
    blank = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (900, 901, 902, 909)}
    assert set(blank.values()) == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()
    assert langid.annotate(empty, langid.train(empty)).count() == 0


def test_backoff_uses_the_longest_known_grams():
    grams = {5: (["^abc$"], [[0.0, -9.0]]), 1: (["z"], [[-9.0, 0.0]])}
    model = {"langs": ["a", "b"], "tables": {"w": (["known"], langid.np.zeros((1, 2), "f")), **{
        k: (g, langid.np.array(v, "f")) for k, (g, v) in grams.items()}}}
    s = langid.Scorer(model)
    assert langid.predict("abc", s, ["a", "b"])[0] == "a" and langid.predict("zz", s, ["a", "b"])[0] == "b"
    assert langid.predict("123 !", s, ["a", "b"]) == ("und", 0.0)


# -- personal data --------------------------------------------------------------------

def plain_pii(text):
    """The patterns as the contract writes them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_patterns_like_plain_regexes(docs):
    rnd = random.Random(7)
    texts = [r.text or "" for r in docs.select("text").collect() if len(r.text or "") < 50_000]
    texts += ["".join(rnd.choice("a1+.@-%( 9_é") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["a@b.c_x@y.org", "1.2.3.4.5", "4111 1111 1111 1111", "+1 (555) 010-9999", "0000255.1.1.1", "256.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == plain_pii(t), t


def test_crf_keeps_base_and_adds(docs, empty):
    from pyspark.sql import SparkSession
    rnd = random.Random(2)
    rows = []
    for i in range(240):
        phone = f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"
        mail = f"user{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com"
        rows.append((i, f"call me at {phone} or write to {mail} today please"))
    train = make(SparkSession.getActiveSession(), rows)
    model = pii.train(pii.labelled_table(train))
    base, added = pii.label_batch(["reach jane.roe @ site7.example.com or so"], model)[0]
    assert base == [] and [x[1] for x in added] == [0]
    assert pii.label_batch(["nothing of note in this text"], model) == [([], [])]
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert got[900].spans == "" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest()
    for r in docs.select("doc_id", "text").collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_pii(r.text or "") ) if len(r.text or "") < 50_000 else ""
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[r.doc_id].spans.split(","))
    assert pii.find(empty, pii.train(pii.labelled_table(empty))).count() == 0


def test_viterbi_is_the_best_path():
    import itertools
    rng = pii.np.random.default_rng(0)
    em, tr = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    got = pii.viterbi(em, pii.np.array([4, 2, 3]), tr)
    for b, n in enumerate([4, 2, 3]):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(em[b, i, x] for i, x in enumerate(p)) + sum(tr[x, y] for x, y in zip(p, p[1:])))
        assert tuple(got[b, :n]) == best


# -- secrets --------------------------------------------------------------------------

def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
           if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secret_scan(spark, docs, empty):
    key = "AKIA" + "Q7ZX0P2MN4RT6VB8"
    extra = [(2000, f"é漢 token = \"{'0a1b2c3d' * 5}\" and {key} end"), (2001, "token:token:abcdefgh secret=ab password = hunter2hunter2"),
             (2002, "Xq7Zk2Pw9LmT4vBn8RcD1sFh and electroencephalographically speaking"), (2003, "API_KEY='zzzzzz' apikey: 12345 " + "f" * 24 + "g" + "a" * 23)]
    all_docs = docs.union(make(spark, extra))
    out = {r.doc_id: r for r in secrets.report(secrets.scan(all_docs)).collect()}
    for r in all_docs.select("doc_id", "text").collect():
        base = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_secrets(r.text or "")]
        assert out[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert set(base) <= set(out[r.doc_id].spans.split(",")) | set()
    assert out[2002].spans == "markov:0:24" and out[900].spans == ""
    masked = {r.doc_id: r for r in secrets.mask(all_docs).collect()}
    assert masked[2002].text == "<SECRET> and electroencephalographically speaking" and masked[2002].n_chars == len(masked[2002].text)
    assert key not in masked[2000].text and masked[2000].text.startswith("é漢 <SECRET>") and masked[900].text is None
    assert secrets.scan(empty).count() == 0 and secrets.mask(empty).count() == 0


# -- fingerprints ---------------------------------------------------------------------

def test_fingerprints(docs, empty):
    rows = sorted([(r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in docs.select("doc_id", "text").collect()],
                  key=lambda r: r[0])
    got = sketch.report(sketch.fingerprint_pairs(docs)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id if r.doc_id is not None else -(1 << 63), []).append(r)
    single = {i for i, _ in rows if len(by[i]) == 1}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        if i in single and j in single:
            half = len(t) // 2
            edited = t[:len(t) - half] + u[:half]
            assert by[i][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[i][0].n_chars == len(t)
            if u == t:
                assert by[i][0].near_next == 1.0
    prints = {}
    for r in got:
        if r.doc_id in single:
            assert prints.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[903][0].fingerprint == by[904][0].fingerprint and by[903][0].near_next == 1.0
    assert sketch.report(sketch.fingerprint_pairs(empty)).count() == 0
    one = sketch.report(sketch.fingerprint_pairs(docs.filter("doc_id = 5"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketch_estimates_similarity(spark):
    rnd = random.Random(4)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:3000] + [f"v{i}" for i in range(1000)]))], "a string, b string")
    got = sketch.with_sketches(df, {"a": "x", "b": "y"}).select(
        sketch.likeness(F.col("x"), F.lit(1), F.col("y"), F.lit(2)).alias("j"), sketch.containment(F.col("x"), F.col("y")).alias("c"),
        (sketch.merge(F.col("x"), F.col("y")) == F.array_sort(F.array_union("x", "y"))).alias("m")).first()
    assert abs(got.j - 0.6) < 0.06 and abs(got.c - 0.75) < 0.06 and got.m
