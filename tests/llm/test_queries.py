import glob
import os

import duckdb
import pytest

from leafmill.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field_name", "record_id", "lang"],
    "p2_found": ["field_name", "record_id", "kind", "ordinal"],
    "p3_found": ["field_name", "record_id"],
    "p4_found": ["field_name", "job_id", "block_no", "end_pos"],
    "p5_found": ["unit_key"],
    "p6_found": ["pack_id", "doc_id"],
    "p7_found": ["mix_id", "source"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows)) > 0
    if name in oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{DIR}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        assert sorted(rows) == sorted(con.execute(oracle_sql()[name]).fetchall())


def test_pieces_give_units_back(spark):
    units = {r["unit_key"]: r["source"] for r in spark.read.parquet(f"{DIR}/job_units.parquet").select("unit_key", "source").distinct().collect()}
    whole: dict = {}
    for r in sorted(queries()["p5_pieces"](spark, DIR).collect(), key=lambda r: (r["unit_key"], r["piece_no"])):
        text = whole.get(r["unit_key"], "")
        whole[r["unit_key"]] = text + r["piece"][len(text) - r["start_pos"] :]
    assert whole and all(units[k] == v for k, v in whole.items())
