"""The registered queries against DuckDB, and the pipeline against plain Python."""

import math
import zlib
from collections import defaultdict
from hashlib import md5

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliogrid.llm import _text as T
from foliogrid.llm import jaccard, langid, mixing, oracle, queries
from tests.llm.conftest import alnum, spaced
from tests.llm.test_langid import brute as brute_languages
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_duplicates import survivors

PATH = "/root/testdata/sf0.01"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    df = queries.queries()[name](spark, PATH)
    rel = con.sql(oracle.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert got == want and got


def test_every_query_runs_on_whole_tables(spark):
    n = spark.read.parquet(f"{PATH}/documents.parquet").count()
    for name, rows in (("op1_toxicity", n), ("op6_line_dedup", n), ("op8_jaccard_join", n), ("op9_token_output", n), ("op10_license_scan", n), ("op7_language_id", n + spark.read.parquet(f"{PATH}/pages.parquet").count())):
        assert queries.queries()[name](spark, PATH).count() == rows, name


def language(rows, model):
    """Kept rows of (id, text, lang, source), by the formulas of ``langid`` in plain Python."""
    asked = [(i, r[1], False, r[2], r[3], None, None) for i, r in enumerate(rows)]
    gone = {i for i, _, _, rejected, _ in brute_languages(asked, model) if rejected}
    return [r for i, r in enumerate(rows) if i not in gone]


def plain_pipeline(rows, items, labels, model):
    """The pipeline's rows from (id, text, lang, source), benchmark texts and (id, quality)."""
    rows = language(rows, model)
    least = set(survivors([r[:2] for r in rows if r[0] is not None]))
    rows = list(dict.fromkeys(r for r in rows if r[0] in least)) + [r for r in rows if r[0] is None]
    wins = set()
    for item in items:
        w = alnum(item)
        n = min(10, len(w))
        wins.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))
    hit = lambda w: any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1))
    rows = [r for r in rows if not hit(alnum(r[1]))]
    given = defaultdict(list)
    for d, quality in labels:
        if d is not None and quality is not None:
            given[d].append(2.0 if quality == 1 else 0.5)
    weight = {d: sum(x) / len(x) for d, x in given.items()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    goal, mix = brute_targets(dict(sizes)), []
    for s in sizes:
        full = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        rest, before = goal[s] - full * sizes[s], 0
        name = lambda r: "" if r[0] is None else str(r[0])
        key = lambda r: (-math.log((int(md5(name(r).encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight.get(r[0], 1.0), len(spaced(r[1])))
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = len(spaced(r[1]))
            mix += [r] * (full + (before + n / 2 <= rest and n > 0))
            before += n
    t, at, want = Tokenizer.from_file(queries.word_tokenizer()), 0, []
    for r in sorted(mix, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(r[1], add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_pipeline_equals_plain_python(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    want = plain_pipeline(rows, items, labels, langid.train(docs))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 100


def tables(spark, path, docs, items, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string, doc_id int").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Null ids and texts, empty, blank and very long texts, repeats of rows and ids, clashing columns, odd items and labels."""
    more = odd.where("doc_id = 1").selectExpr("7L as doc_id", "'etwas ganz anderes und noch mehr' as text", "'de' as lang", "'b' as source", "n_words", "labels", "score", "size")
    docs = odd.unionByName(more).cache()
    items = [("a", None, 1), ("a", "", 2), (None, "!!", 3), ("b", "Ein, zwei!", None), ("b", "Ein, zwei!", 1)]
    labels = [(None, 1, 1, None), (1, None, None, None), (6, 0, 0, "x"), (6, 1, 0, "x"), (10, 1, None, ""), (10, 1, None, "")]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = plain_pipeline(rows, [r[1] for r in items], [r[:2] for r in labels], langid.train(docs))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, tables(spark, tmp_path / "odd", docs, items, labels)).collect()), key=lambda r: r[1])
    assert got == want and {r[0] for r in want} <= {None, 1, 6, 7, 9, 10} and len(want) > 3


def test_pipeline_on_empty_tables(spark, odd, empty, tmp_path):
    none = corpus_pipeline.run(spark, tables(spark, tmp_path / "none", empty, [], []))
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    some = corpus_pipeline.run(spark, tables(spark, tmp_path / "some", odd, [], [])).collect()
    # without a benchmark nothing is contaminated: 7 or 8, or both, stay
    assert {r.doc_id for r in some} & {7, 8}
    silent = odd.where("text is null or doc_id in (4, 5)")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "silent", silent, [], [])).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, PATH)
        assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count(), name
    assert T.STEP and mixing.MAX_EPOCHS == 2 and jaccard.PERCENT == 90
