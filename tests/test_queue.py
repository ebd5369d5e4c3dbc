"""Job queues against their SQL, on events whose jobs are few, new or of unknown kind."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foliogrid import registry

KINDS = ["click", "view", "purchase", "error", "signup", "other", None]


@pytest.mark.parametrize("name", ["q01_enqueue", "q04_job_state"])
def test_sparse_queue_agrees_with_sql(spark, tmp_path, name):
    n = 5000
    start = datetime.datetime(2024, 1, 1)
    # one to three events of a job, so that many are only new and many only old
    rows = [{"event_id": i, "ts": start + datetime.timedelta(seconds=i), "user_id": i * 7919 % 499, "event_type": KINDS[i * 31 % 97 % 7], "value": float(i % 13), "props": None if i % 5 == 0 else f"p{i}"} for i in range(n)]
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    con.execute(f"create table expected as {registry.oracle_sql()[name]}")
    columns = [r[0] for r in con.execute("describe expected").fetchall()]
    picked = [c for c in columns if not c.endswith("_at")]
    got = sorted((tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*picked).collect()), key=repr)
    expected = sorted(con.execute(f"select {', '.join(picked)} from expected").fetchall(), key=repr)
    assert got == expected
    if name == "q01_enqueue":
        assert all(r[picked.index("inserted")] is not None for r in got)
