"""Language ID over pages and documents against plain Python, and its defined results."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.llm import langid, queries

PATH = "/root/testdata/sf0.001"


def likelihood(text, model):
    """(log-likelihoods, letters) of a text, window by window."""
    data = (text or "").encode()
    low, table = [int(langid._BYTES[b]) for b in data], model.table.astype(np.float64)
    total, n = np.zeros(table.shape[1]), 0
    for i in range(len(data) - 2):
        if any(langid._LETTER[b] for b in data[i : i + 3]):
            h = ((low[i] * 0x9E3779B1 + low[i + 1]) * 0x85EBCA6B + low[i + 2]) % (1 << 32)
            h ^= h >> 15
            total += table[(h * 0x2C1B3C6D % (1 << 32)) >> 16]
            n += 1
    return total / max(n, 1) * (n / (1 + n / langid.EVIDENCE)), sum(bool(langid._LETTER[b]) for b in data)


def visible(html):
    """The text outside tags; a tag that never closes goes on to the end."""
    out, inside = [], False
    for c in html or "":
        inside = (inside or c == "<") and c != ">"
        if not inside and c != ">":
            out.append(c)
    return "".join(out)


def parts(url):
    """(host, domain, suffix)"""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    host = m[1].lower() if m else None
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]) if len(labels) > 1 else host, labels[-1] if len(labels) > 1 else None


def brute(rows, model):
    """(id, language or und, confidence, rejected, letters) of (id, text, is markup, declared, host, domain, suffix)."""
    k = len(model.languages) + 1
    names = [*model.languages, "und"]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    scored = [likelihood(visible(r[1]) if r[2] else r[1], model) for r in rows]
    own = [soft(ll) if n else np.zeros(k) for ll, n in scored]
    whole = sum(own, np.zeros(k))
    share = (whole + 0.5) / (whole + 0.5).sum()
    share[-1] = langid.UND_PRIOR
    share /= share.sum()
    tables = [defaultdict(lambda: np.zeros(k)) for _ in range(4)]  # declared, host, domain, suffix
    for r, o in zip(rows, own):
        for t, key in zip(tables, r[3:]):
            t[key] += o
    out = []
    for r, (ll, n), o in zip(rows, scored, own):
        declared, host, domain, suffix = (np.maximum(t[key] - o, 0) if key is not None else np.zeros(k) for t, key in zip(tables, r[3:]))
        near = (domain + 20 * share) / (domain.sum() + 20)
        post = np.log(np.maximum((host + 10 * near) / (host.sum() + 10), 1e-9)) + (ll if n else 0)
        for key, x in ((r[6], suffix), (r[3], declared)):
            if key is not None:
                post = post + np.log((x + 1) / (whole + 20))
        best = int(np.argmax(post))
        silent = not n and r[3] is None and r[4] is None
        lang = "und" if silent else names[best]
        out.append((r[0], lang, round(float(soft(post).max()), 6), lang == "und" or not n, n))
    return sorted(out, key=str)


ODD = [
    (-1, None, None),
    (-2, "", "http://b.example.de/"),
    (-3, "<html lang=de><p>x1</p>", "https://u@A.b.Example.co.uk:80/x?y"),
    (-3, "<html lang=de><p>x1</p>", "https://u@A.b.Example.co.uk:80/x?y"),
    (-4, "no tags, an open < one to the end <html lang='fr'", "nothing"),
    (-5, "<html lang='DE-at'>" + "Der die das und ist von mit. " * 40_000 + "<a" + " b" * 400_000 + ">ein</a>", "http://localhost/"),
    (None, "<b></b>1 2 3", "http://a.example.de/"),
]


def test_pages_and_documents_equal_plain_python(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = langid.train(docs)
    pages = spark.read.parquet(f"{PATH}/pages.parquet").select("page_id", "html", "url").unionByName(spark.createDataFrame(ODD, "page_id long, html string, url string"))
    pages = pages.unionByName(docs.where("doc_id < 60").selectExpr("doc_id + 100000 as page_id", "concat('<html lang=\"', lang, '\">', text) as html", "concat('https://h', doc_id % 3, '.site.', lang, '/') as url"))
    host, domain, suffix = langid.address(F.col("url"))
    df = pages.select("page_id", "html", langid.declared_in(F.col("html")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.lit(True).alias("mark"), F.lit(1).alias("letters"), F.lit("x").alias("lang"))
    got = langid.identify(df, model, ["page_id"], "html", "mark", "declared", "host", "domain", "suffix")
    assert got.columns == ["page_id", "lang", "confidence", "rejected", "letters"]
    rows = []
    for r in pages.collect():
        said = re.search(r"(?i)<html[^>]{0,500}?\slang\s*=\s*[\"']?([a-z]{2,3})", r.html or "")
        rows.append((r.page_id, r.html, True, said[1].lower() if said else None, *parts(r.url)))
    assert sorted(((r.page_id, r.lang, round(r.confidence, 6), r.rejected, r.letters) for r in got.collect()), key=str) == brute(rows, model)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    none = docs.where("false")
    assert langid.train(none).languages == [] and langid.known_language(none, langid.train(docs)).count() == 0
    assert {r.lang for r in langid.identify(docs.limit(5).withColumn("n", F.lit(None).cast("string")), langid.train(none), ["doc_id"], "text", None, "n", "n", "n", "n").collect()} == {"und"}


def test_a_long_row_is_read_in_blocks(spark, monkeypatch):
    model = langid.train(spark.read.parquet(f"{PATH}/documents.parquet"))
    data = np.frombuffer(("<p> Der <b" + "die" * 50 + "> das und ist é漢 " + "von < mit " * 30).encode() * 3, np.uint8)
    offsets = np.array([0, len(data)])
    whole = model.scores(data, offsets), langid._visible(data, offsets, np.array([True]))
    for step in (7, 64, 1000):
        monkeypatch.setattr(T, "STEP", step)
        ll, own, letters = model.scores(data, offsets)
        assert np.allclose(ll, whole[0][0]) and np.allclose(own, whole[0][1]) and (letters == whole[0][2]).all()
        assert bytes(langid._visible(data, offsets, np.array([True]))[0]) == bytes(whole[1][0])


def test_rows_without_a_key_are_no_hot_key(spark, monkeypatch):
    """With tables beyond the broadcast bound the joins shuffle, and nulls are dealt out."""
    monkeypatch.setattr(langid, "small", lambda df: df)
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = langid.train(docs)
    monkeypatch.undo()
    want = sorted(map(str, queries.op7_language_id(spark, PATH).collect()))
    monkeypatch.setattr(langid, "small", lambda df: df)
    assert sorted(map(str, queries.op7_language_id(spark, PATH).collect())) == want and len(model.languages) == 4


@pytest.mark.parametrize("text", ["12 34", ""])
def test_letterless_documents_go(spark, text):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    some = docs.limit(3).withColumn("text", F.lit(text))
    kept = langid.known_language(docs.unionByName(some), langid.train(docs))
    assert kept.count() == docs.count() and kept.columns == docs.columns and math.isfinite(kept.count())
