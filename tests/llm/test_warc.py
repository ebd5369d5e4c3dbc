from pyspark.sql import functions as F

from foliogrid.llm import queries
from foliogrid.llm import warc as W


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    return W.pack(pages.select("page_id", W.record(F.col("page_id"), F.col("url"), F.col("html")).alias("rec")), "page_id", "rec")


def test_numbers_and_offsets(spark):
    rows = [(i % 900, f"http://x/{i}", "é" * (i % 13), "") for i in range(9000)] + [(None, None, None, "")] * 3
    got = archive(spark, rows).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(9003)) and got[0].id is None
    at = 0
    for r in got:
        at = 0 if r.number == 0 else at
        assert (r.file, r.number, r.offset) == (r.ordinal // W.PER_FILE, r.ordinal % W.PER_FILE, at)
        at += r.length
    assert got[5].length > 100 and archive(spark, rows).where("false").count() == 0


def test_audit_finds_just_what_differs(spark):
    a = archive(spark, [(i, "u", str(i), "") for i in range(5000)]).select("ordinal", "offset", "length", "sha").cache()
    b = a.where("ordinal not in (7, 4095)").withColumn("sha", F.when(F.col("ordinal").isin(0, 300, 4999), "bad").otherwise(F.col("sha")))
    b = b.unionByName(spark.createDataFrame([(5000, 7, 1, "new")], "ordinal long, offset long, length long, sha string"))
    got = {r.ordinal: r.kind for r in W.audit(a, b).collect()}
    assert got == {7: "missing", 4095: "missing", 0: "altered", 300: "altered", 4999: "altered", 5000: "extra"}
    assert W.audit(a, a).count() == 0
    none = a.where("false")
    assert W.audit(none, none).count() == 0 and W.audit(none, a.where("ordinal < 3")).count() == 3


def test_tree_has_a_fifteenth_more_rows(spark):
    a = archive(spark, [(i, "u", str(i), "") for i in range(5000)])
    levels = W.tree(a.withColumn("replica", F.lit("a")))
    assert [x.count() for x in levels] == [5000, 313, 20, 2, 1]


def test_query_finds_the_decay(spark):
    got = queries.op3_warc_fixity(spark, "/root/testdata/sf0.1").collect()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    fate = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    want = {r.page_id for r in pages.where(fate.isin("00", "01", "02")).collect()}
    assert want and {r.page_id for r in got} == want


def test_moved_records_are_told(spark):
    a = archive(spark, [(i, "u", str(i), "") for i in range(300)]).select("ordinal", "offset", "length", "sha").cache()
    b = a.withColumn("offset", F.col("offset") + F.when(F.col("ordinal") == 17, 3).otherwise(0))
    assert [(r.ordinal, r.kind, r.replica_offset - r.offset) for r in W.audit(a, b).collect()] == [(17, "moved", 3)]


def test_archives_are_written_and_read(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "é<p>\r\n\n" * (i % 7) + "\r\n" * (i % 2)) for i in range(5000)] + [(None, None, None), (3, "again", ""), (3, "again", "")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, sha string")
    records = pages.select("page_id", W.record(F.col("page_id"), F.col("url"), F.col("html")).alias("rec"))
    index = W.write_archive(records, f"{tmp_path}/warc", "page_id", "rec").cache()
    own = index.select("ordinal", "offset", "length", "sha")
    assert index.count() == len(rows) and W.audit(own, W.read_replica(index, f"{tmp_path}/warc")).count() == 0
    parts = sorted((tmp_path / "warc").glob("file=*/part-*"))
    assert len(parts) == 2
    whole = parts[0].read_bytes()
    assert whole.count(b"WARC/1.1\r\n") == W.PER_FILE and whole.endswith(b"\r\n\r\n")
    at = index.where("ordinal = 2000").first()
    parts[0].write_bytes(whole[: at.offset + 5] + b"#" + whole[at.offset + 6 :])  # one byte is another
    tail = parts[1].read_bytes()
    parts[1].write_bytes(tail[:-10])  # the last record is cut short
    for crc in (tmp_path / "warc").rglob(".*.crc"):
        crc.unlink()
    found = W.audit(own, W.read_replica(index, f"{tmp_path}/warc")).collect()
    assert sorted((r.ordinal, r.kind) for r in found) == [(2000, "altered"), (len(rows) - 1, "altered")]


def test_empty_and_odd_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.mode("overwrite").parquet("/tmp/foliogrid-test-none/pages.parquet")
    assert queries.op3_warc_fixity(spark, "/tmp/foliogrid-test-none").count() == 0
    rows = [(None, None, None)] * 4 + [(7, "u", None)] * 3 + [(7, None, "")] * 2
    a = archive(spark, [(*r, "") for r in rows]).select("ordinal", "offset", "length", "sha")
    assert a.count() == 9 and W.audit(a, a).count() == 0 and [r.kind for r in W.audit(a, a.where("ordinal <> 8")).collect()] == ["missing"]
