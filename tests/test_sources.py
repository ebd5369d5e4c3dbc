import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliogrid.sources import readers as R


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": 1}\n\n[1]\n{broken\n"x"\n{"a": 2, "b": "z"}\n{"a": 3}\n')
    assert [tuple(r) for r in R.json_lines(spark, path, "a int, b string").orderBy("a").collect()] == [(1, None), (2, "z"), (3, None)]
    assert R.json_lines(spark, path, "a int", 2).count() == 2
    R.write_json_lines(R.json_lines(spark, path, "a int, b string"), f"{tmp_path}/out")
    assert R.json_lines(spark, f"{tmp_path}/out", "a int, b string").count() == 3


def test_glossaries(spark, tmp_path):
    write(tmp_path / "g/math.json", json.dumps([{"en": "kernel", "zh": "he", "force": True, "aliases": ["ker"]}, {"en": "", "zh": "x"}]))
    write(tmp_path / "g/cs.json", json.dumps({"domain": "cs_ml", "terms": [{"en": "kernel", "zh": "neihe"}, {"zh": "y"}]}))
    write(tmp_path / "g/bad.json", "{nonsense")
    got = {(r.domain, r.en, r.zh, r.force, tuple(r.aliases)) for r in R.glossary_folder(spark, f"{tmp_path}/g").collect()}
    assert got == {("math", "kernel", "he", True, ("ker",)), ("cs_ml", "kernel", "neihe", False, ())}
    csv = write(tmp_path / "t.csv", 'en,zh,domain,force,aliases,notes\nring,huan,math,TRUE,"a, b,",n\n,x,,,,\nset,ji,,no,,\n')
    got = [(r.en, r.zh, r.domain, r.force, r.aliases) for r in R.import_glossary(spark, csv).orderBy("en").collect()]
    assert got == [("ring", "huan", "math", True, ["a", "b"]), ("set", "ji", "", False, [])]
    with pytest.raises(ValueError):
        R.import_glossary(spark, "terms.txt")


def test_annotations(spark, tmp_path):
    path = write(tmp_path / "n.json", json.dumps({"d1": {"b1": " note ", "b2": "  ", "b3": 5}, "d2": {}, "d3": "odd"}))
    store = R.annotations(spark, path)
    assert {tuple(r) for r in store.collect()} == {("d1", "b1", "note"), ("d1", "b3", "5")}
    assert R.annotations(spark, write(tmp_path / "broken.json", "{oops")).count() == 0
    patched = R.patch_annotations(store, spark.createDataFrame([("d1", "b1", ""), ("d1", "b3", "six"), ("d9", "b", "new"), ("d9", "c", None)], "doc_hash string, block_id string, note string"))
    assert {tuple(r) for r in patched.collect()} == {("d1", "b3", "six"), ("d9", "b", "new")}
    assert {r.doc_hash: json.loads(r.notes) for r in R.annotation_json(patched).collect()} == {"d1": {"b3": "six"}, "d9": {"b": "new"}}


def test_tex_tree_in_order_of_inclusion(spark, tmp_path):
    write(tmp_path / "tree/main.tex", "\\input{a}\n% \\input{never}\n\\include{ sub/b.tex }\\input{a}\\input{c}")
    write(tmp_path / "tree/a.tex", "A \\input{c}")
    write(tmp_path / "tree/c.tex", "C \\input{a}")
    write(tmp_path / "tree/sub/b.tex", "B \\input{missing}")
    write(tmp_path / "tree/never.tex", "N")
    write(tmp_path / "tree/build/x.tex", "X")
    files = R.tex_files(spark, f"{tmp_path}/tree")
    assert {r.path for r in files.collect()} == {"main.tex", "a.tex", "c.tex", "sub/b.tex", "never.tex"}
    assert [r.path for r in R.include_order(files, "main.tex").orderBy("order").collect()] == ["main.tex", "a.tex", "c.tex", "sub/b.tex"]


def test_logs_and_synctex(spark, tmp_path):
    path = write(tmp_path / "a.log", "\n".join(f"12:00 [{'ERROR' if i % 10 == 0 else 'INFO'}] step took {i}.5 ms" for i in range(30)))
    got = R.log_tail(spark, path, 12).orderBy("place").collect()
    assert len(got) == 12 and got[-1].ms == 29.5 and [r.level for r in got].count("ERROR") == 1
    text = "head\nSyncTeX result begin\nOutput:a.pdf\nPage:3\nx:1.5\ny:2\nh:1\nv:2\nW:10\nH:4\nOutput:a.pdf\nPage:5\nx:7\ny:8\nh:1\nv:2\nW:3\nH:4\nSyncTeX result end\n"
    rows = R.synctex_records(spark.createDataFrame([(text,)], "value string"))
    assert [(r.page, r.x, r.w) for r in rows.orderBy("place").collect()] == [(3, 1.5, 10.0), (5, 7.0, 3.0)]
    assert R.best_synctex(rows, 4, 9).first().page == 5 and R.best_synctex(rows, 8, 9).first().page == 3


def test_glyph_names(spark, tmp_path):
    path = write(tmp_path / "list.txt", "# comment\nalpha;03B1\nfi 0066 0069 # two\nscriptA;1D49C\nbad line here\n\n")
    got = {r.name: r.unicode for r in R.glyph_names(spark, path, 5, "own").collect()}
    assert got == {"alpha": "α", "fi": "fi", "scriptA": "\U0001d49c"}


def test_files_and_partitions(spark, tmp_path):
    path = write(tmp_path / "f.bin", "hello")
    row = R.file_ids(spark, path).first()
    assert row.sha256 == hashlib.sha256(b"hello").hexdigest() and row.doc_hash == row.sha256[:16]
    base = spark.range(6).selectExpr("id % 3 as doc_id", "id as page_num")
    R.write_index(base, f"{tmp_path}/i")
    R.write_index(base.where("doc_id = 1").withColumn("page_num", F.lit(99).cast("long")), f"{tmp_path}/i")
    assert sorted((r.doc_id, r.page_num) for r in spark.read.parquet(f"{tmp_path}/i").collect()) == [(0, 0), (0, 3), (1, 99), (1, 99), (2, 2), (2, 5)]
    assert R.page_range(base, 2, 2).count() == 2 and R.page_range(base, 2, None).count() == 4 and R.page_range(base, 1, 0).count() == 5
