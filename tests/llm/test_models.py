"""Toxicity and language ID: held-out accuracy and defined results."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.llm import langid, toxicity
from tests.llm.conftest import alnum

PATH = "/root/testdata/sf0.1"


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 3))
    truth = x @ [2.0, -1.0, 0.0] + rng.logistic(size=3000)
    y = np.digitize(truth, [-1, 1, 2.5])
    rows, cols = np.nonzero(np.ones_like(x))
    w, cuts = toxicity.fit_cumulative_link(rows, cols, x[rows, cols], y, 3)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 1) < 0.3 and abs(w[2]) < 0.2
    assert np.all(np.abs(cuts - [-1, 1, 2.5]) < 0.35)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    model = toxicity.train(docs, labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0))
    got = toxicity.severity(docs, model).join(labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0), "doc_id").toPandas()
    bad = got.toxic.iloc[:, 0] if getattr(got.toxic, "ndim", 1) == 2 else got.toxic
    said = got.p_toxic >= 0.5
    truth = labels.toPandas().groupby("doc_id").toxic.max().reindex(got.doc_id).to_numpy() == 1
    assert said[truth].mean() >= 0.9 and said[~truth].mean() <= 0.02, (said[truth].mean(), said[~truth].mean(), bad is None)
    assert got.severity[truth].mean() > 1.2 and got.severity[~truth].mean() < 0.1


def buckets_of(text):
    """Buckets of a text's 5-byte windows and words, one by one."""
    data, out = (text or "").encode(), []
    for i in range(len(data) - toxicity.WINDOW + 1):
        h = 0
        for b in data[i : i + toxicity.WINDOW]:
            h = (h * 0x9E3779B1 + int(toxicity._BYTES[b])) % (1 << 32)
            h ^= h >> 15
        h = h * 0x85EBCA6B % (1 << 32)
        out.append((h >> (33 - toxicity.BITS)) + (1 << (toxicity.BITS - 1)))
    for w in alnum(text):
        raw = np.frombuffer(w.encode(), np.uint8)
        out.append(int(T.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]) >> (65 - toxicity.BITS))
    return out


def brute_severity(text, model):
    counts = Counter(b for b in buckets_of(text) if b in set(model.buckets.tolist()))
    x = sum(math.log1p(counts[b]) * w for b, w in zip(model.buckets.tolist(), model.weights.tolist()))
    return sum(0.0 if c == toxicity.NEVER else 1 / (1 + math.exp(min(60, max(-60, c - x)))) for c in model.cuts)


def brute_signs(rows, features):
    """Buckets that a plain count of documents ties to toxicity, best first; rows of (text, toxic)."""
    n, held = Counter(), (Counter(), Counter())
    for text, bad in rows:
        n[bad] += 1
        held[bad].update(set(buckets_of(text)))
    found = []
    for b, x in held[1].items():
        a, c = x / n[1], held[0][b] / n[0]
        if x >= toxicity.LEAST and a / (c + 0.5 / n[0]) > toxicity.LIFT:
            found.append((-(a - c) / math.sqrt((a * (1 - a) + 0.5 / n[1]) / n[1] + (c * (1 - c) + 0.5 / n[0]) / n[0]), b))
    return [b for _, b in sorted(found)[:features]]


def planted(spark, odd):
    """Odd rows, and short texts of which every third holds one or both bad words; their labels."""
    rows = [(100 + i, f"plain words number {i}" + (" vile" if i % 3 == 0 else "") + (" nasty" if i % 6 == 0 else "")) for i in range(60)]
    docs = odd.select("doc_id", "text", "labels", "score").unionByName(spark.createDataFrame([(*r, "x", 0.5) for r in [*rows, rows[0], rows[3]]], "doc_id long, text string, labels string, score double"))
    marks = [(i, 1, int(i >= 100 and (i - 100) % 3 == 0)) for i in [1, 2, 3, 4, 5, 6, 7, 9, *range(100, 160)]] + [(1, 1, 0), (999, 1, 1), (None, 0, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_equals_brute_force(spark, odd):
    docs, labels = planted(spark, odd)
    model = toxicity.train(docs, labels, features=40)
    texts = {}
    for r in docs.collect():
        texts[r.doc_id] = min((x for x in (texts.get(r.doc_id), r.text) if x is not None), default=None)
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and r.doc_id is not None}
    assert model.buckets.tolist() == brute_signs([(texts[d], bad) for d, bad in marks.items()], 40)
    said = toxicity.severity(docs, model).collect()
    want = [(r.doc_id, round(brute_severity(r.text, model), 9)) for r in docs.collect()]
    assert sorted(((r.doc_id, round(r.severity, 9)) for r in said), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in said}
    assert by[103].toxic and by[100].severity > by[103].severity - 1e-9 and not by[101].toxic and by[3].severity == by[4].severity == by[5].severity < 0.1
    assert all(np.diff(model.cuts) > 0)


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(11), labels.repartition(3), tasks=211)
    assert a.buckets.tolist() == b.buckets.tolist() and a.weights.tolist() == b.weights.tolist() and a.cuts.tolist() == b.cuts.tolist() and len(a.buckets) > 100


def test_toxicity_defined_results(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.severity(odd, model).collect()
    assert len(got) == odd.count() and {r.severity for r in got} == {0.0} and toxicity.severity(empty, model).count() == 0
    assert len(toxicity.train(empty, labels).buckets) == len(toxicity.train(odd, labels.where("false")).buckets) == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = langid.train(docs, sample=300)
    assert model.languages == ["de", "en", "es", "fr"]
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", none.alias("d"), none.alias("h"), none.alias("m"), none.alias("x"), F.col("lang").alias("truth"))
    got = langid.identify(rows, model, ["doc_id", "truth"], "text", None, "d", "h", "m", "x").toPandas()
    assert (got.lang == got.truth).mean() >= 0.98 and got.rejected.mean() < 0.005
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.995 * docs.count()


def test_evidence_moves_short_texts(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = langid.train(docs, sample=300)
    pages = [(i, "<html lang=\"de\"><body><p>Der die das und ist von mit</p></body></html>", f"http://a.example.de/{i}") for i in range(60)]
    pages += [(100, "<html><p>x1</p></html>", "http://a.example.de/x"), (101, "<html lang='de'><p>x1</p>", None), (102, "<html><b></b>", None), (103, None, None), (104, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字", None), (104, "", "http://b.example.de/")]
    host, domain, suffix = langid.address(F.col("url"))
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    df = df.select("page_id", "html", langid.declared_in(F.col("html")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.lit(True).alias("is_html"))
    got = {(r.page_id, r.letters): r for r in langid.identify(df, model, ["page_id"], "html", "is_html", "declared", "host", "domain", "suffix").collect()}
    assert len(got) == len(pages) and next(r for k, r in got.items() if k[0] == 5).lang == "de" and got[100, 1].lang == "de" and got[101, 1].lang == "de"
    assert got[102, 0].rejected and got[103, 0].rejected and got[103, 0].lang == "und"
    assert [r.lang for k, r in got.items() if k[0] == 104 and k[1]] == ["und"]


def test_addresses(spark):
    df = spark.createDataFrame([("https://u@A.b.Example.co.uk:80/x?y",), ("http://localhost/",), ("nothing",), (None,)], "url string")
    host, domain, suffix = langid.address(F.col("url"))
    assert [tuple(r) for r in df.select(host, domain, suffix).collect()] == [("a.b.example.co.uk", "co.uk", "uk"), ("localhost", "localhost", None), (None, None, None), (None, None, None)]


def test_language_odd_rows(spark, odd, empty):
    model = langid.train(odd, least=1)
    kept = langid.known_language(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6}
    assert not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert langid.known_language(empty, model).count() == 0


def test_rare_languages_have_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    assert langid.known_language(docs, model).where("lang = 'es'").count() == docs.where("lang = 'es'").count() == 17
    all_docs = spark.read.parquet(f"{PATH}/documents.parquet")
    few = all_docs.where("lang = 'es'").orderBy("doc_id").limit(2)
    model = langid.train(all_docs.where("lang <> 'es'").unionByName(few), sample=300)
    none = F.lit(None).cast("string")
    rows = all_docs.join(few.select("doc_id"), "doc_id", "left_anti").where(F.pmod("doc_id", F.lit(8)) == 0).select("doc_id", "text", none.alias("d"), none.alias("h"), none.alias("m"), none.alias("x"), F.col("lang").alias("truth"))
    got = langid.identify(rows, model, ["doc_id", "truth"], "text", None, "d", "h", "m", "x").toPandas()
    rare = got.truth == "es"
    assert (got.lang == got.truth)[rare].mean() >= 0.95 and (got.lang == got.truth)[~rare].mean() >= 0.98
    assert langid.train(docs.where("lang = 'fr'").limit(1)).languages == ["fr"] and langid.train(docs.select("doc_id", F.lit("12 34").alias("text"), "lang")).languages == []
