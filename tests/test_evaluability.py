"""C26_evaluability on a table whose values are partly missing: the query counts rows, as its SQL does."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

import __spark_entry__


def test_rows_without_a_value_count_as_seen(spark, tmp_path):
    events = pq.read_table("/root/testdata/sf0.001/events.parquet")
    at = events.schema.get_field_index("value")
    value = pc.if_else(pc.equal(pc.bit_wise_and(pc.cast(events["event_id"], pa.int64()), 3), 1), pa.scalar(None, events.schema.field(at).type), events["value"])
    pq.write_table(events.set_column(at, "value", value), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()["C26_evaluability"])
    want = [dict(zip([d[0] for d in cur.description], row)) for row in cur.fetchall()]
    got = [row.asDict() for row in __spark_entry__.queries()["C26_evaluability"](spark, str(tmp_path)).collect()]
    assert got == want
