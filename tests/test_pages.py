"""Pages that are worked on side by side against one page at a time, and plans without a Python call for each page."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid import registry
from foliogrid.operators import decode, layout, pages

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a15_evidence_clusters", "x01_display_regions", "x02_region_latex", "x11_decoded_structures", "x12_graph_latex", "x13_verified_candidates"])
def test_no_python_call_for_each_page(spark, name):
    plan = registry.queries()[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    # large pages of `local_pairs` go to Python one by one
    assert "CoGroup" not in plan and plan.count("FlatMapGroupsInPandas") <= ("x1" in name) and "MapInArrow" in plan


def _clusters_of_page(boxes):
    united, numbers = [], []
    for b in boxes:
        best, at = np.inf, len(united)
        for k, u in enumerate(united):
            gap_x, gap_y = max(0, max(b[0], u[0]) - min(b[2], u[2])), max(0, max(b[1], u[1]) - min(b[3], u[3]))
            level = min(b[3], u[3]) - max(b[1], u[1]) >= -1.25 * max(b[3] - b[1], 1, u[3] - u[1])
            over = min(b[2], u[2]) - max(b[0], u[0]) >= -18
            if (level and gap_x <= 36 or over and gap_y <= 16) and gap_x + gap_y < best:
                best, at = gap_x + gap_y, k
        if at == len(united):
            united.append(list(b))
        else:
            u = united[at]
            united[at] = [min(u[0], b[0]), min(u[1], b[1]), max(u[2], b[2]), max(u[3], b[3])]
        numbers.append(at)
    return numbers


def test_clusters_as_one_page_at_a_time(spark):
    # pages of 1 to 9 boxes and two of 300, whose clusters are many
    boxes = spark.range(45).selectExpr("id as page", "id % 9 + 1 as n").union(spark.range(2).selectExpr("100 + id", "300L"))
    boxes = boxes.selectExpr("if(page = 44, null, page) as page", "explode(sequence(1, int(n))) as i").selectExpr("page", "i as id", "double(hash(page, i) % 400) as x0", "double(hash(i, page) % 300) as y0")
    boxes = boxes.withColumn("x1", F.expr("x0 + 3 + id % 7")).withColumn("y1", F.expr("y0 + 4 + id % 5"))
    got, pages = {}, {}
    for r in layout.clustered(boxes, ["page"]).collect():
        got[r.page, r.id] = r.cluster
        pages.setdefault(r.page, []).append((r.y0, r.x0, r.id, r.x1, r.y1))
    assert len(got) == boxes.count() and max(got.values()) > 20
    for page, rows in pages.items():
        rows.sort()
        assert [got[page, r[2]] for r in rows] == _clusters_of_page([(r[1], r[0], r[3], r[4]) for r in rows])


def test_rows_of_all_sides_meet_by_page(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "c", 3.0), (None, "d", 4.0)], "page long, name string, x double")
    right = spark.createDataFrame([(1, 7), (3, 8), (None, 9)], "page long, n int")

    def run(a, b):
        yield ",".join(f"{n}:{x}" for n, x in sorted(a)), sum(n for (n,) in b)

    got = {r.page: (r.names, r.total) for r in pages.mapped_pages([left, right], ["page"], run, "names string, total int").collect()}
    assert got == {1: ("a:1.0,b:None", 7), 2: ("c:3.0", 0), 3: ("", 8), None: ("d:4.0", 9)}
    assert pages.mapped_pages([left.where("false"), right.where("false")], ["page"], run, "names string, total int").count() == 0


def test_order_of_relations_changes_no_structure(spark):
    rows = [(1, f"n{i}", f"n{j}", kind, 0.5) for i in range(6) for j in range(i + 1, 6) for kind in ("NEXT", "SUP", "SUB")]
    structures = [sorted(decode.decode(spark.createDataFrame(r, "row_id long, source string, target string, relation string, confidence double").coalesce(1)).collect()) for r in (rows, rows[::-1])]
    assert structures[0] == structures[1] and len(structures[0]) > 2


def test_graph_features_deal_pairs_once(spark, tmp_path):
    """Pages up to 72 nodes and one beyond against the SQL, and no exchange by a pair's ends."""
    name = "g08_graph_features"
    items = [(page, i % 7 + 1, i * 37 % 991 + 1, i * 11 % 97 + 1, float(i)) for page, n in ((1, 1), (2, 5), (3, 71), (4, 73)) for i in range(n)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    want = {r[:2]: r for r in expected.fetchall()}
    got = {(r.source, r.target): tuple(r) for r in df.select(*columns).collect()}
    assert got.keys() == want.keys()
    # pages of more than 72 nodes look at windows, and their nearest are exact
    for k, row in want.items():
        assert got[k] == pytest.approx(row, abs=2e-6), k
    # degrees come from a page's map, not from a join by a pair's ends
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan
