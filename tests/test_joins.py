import pytest
from pyspark.sql import functions as F

from leafmill.operators import alignment, joins, layout


def test_unique_pairs(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), (None, 4)], "k string, a long")
    b = spark.createDataFrame([("x", 7), ("y", 8), (None, 9)], "k string, b long")
    assert [tuple(r) for r in joins.unique_pairs(a, b, ["k"], "a", "b").collect()] == [("x", 1, 7)]


def test_nearest_against_brute_force(spark):
    a = [(1, i, (i * 37) % 101 / 3) for i in range(40)]
    b = [(1, i, (i * 53) % 97 / 2) for i in range(30)]
    got = {r["ia"]: (r["ib"], round(r["distance"], 9)) for r in joins.nearest(spark.createDataFrame(a, "k long, ia long, x double"), spark.createDataFrame(b, "k long, ib long, y double"), ["k"], "x", "y", "ia", "ib", 1.5).collect()}
    want = {}
    for _, i, x in a:
        d, j = min((abs(x - y), j) for _, j, y in b)
        if d <= 1.5:
            want[i] = (j, round(d, 9))
    assert got == want


def test_anchored_intervals(spark):
    schema = "g long, place long, anchor string, slot string"
    a = spark.createDataFrame([(1, 1, None, "a1"), (1, 2, "k1", "a2"), (1, 3, None, "a3"), (1, 4, None, "a4"), (1, 5, "k2", "a5")], schema)
    b = spark.createDataFrame([(1, 1, "k1", "b1"), (1, 2, None, "b2"), (1, 3, "k2", "b3"), (1, 4, None, "b4")], schema)
    got = {(r["slot_a"], r["slot_b"]) for r in joins.anchored_intervals(a, b, "g", "place", "anchor", "slot").collect()}
    assert got == {("a1", None), ("a2", "b1"), ("a3", "b2"), ("a4", None), ("a5", "b3"), (None, "b4")}


def test_time_warp(spark):
    events = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 5.0, 10.0, 12.0)], "k long, t double")
    knots = spark.createDataFrame([(1, 0.0, 100.0), (1, 10.0, 120.0)], "k long, from_time double, to_time double")
    got = [r["warped"] for r in joins.time_warp(events, knots, ["k"], "t").orderBy("t").collect()]
    assert got == pytest.approx([99, 100, 110, 120, 122])


def test_until_stable(spark):
    df = spark.createDataFrame([(3,), (1,)], "n long")
    out, passes, why = joins.until_stable(df, lambda d: d.select(F.greatest(F.col("n") - 1, F.lit(0)).alias("n")), lambda d: F.col("n") > 0)
    assert (passes, why) == (3, "stable") and out.agg(F.sum("n")).first()[0] == 0
    assert joins.until_stable(df, lambda d: d.select((4 - F.col("n")).alias("n")), lambda d: F.col("n") > 0)[2] == "repeats"
    assert joins.until_stable(df, lambda d: d.select((F.col("n") + 1).alias("n")), lambda d: F.col("n") > 0, most=2)[1:] == (2, "limit")


def test_fingerprint(spark):
    rows = [("b", f"f{i}", str(i)) for i in range(20)]
    one = joins.fingerprint(spark.createDataFrame(rows, "k string, f string, h string"), ["k"], "f", "h").first()["fingerprint"]
    two = joins.fingerprint(spark.createDataFrame(rows[::-1], "k string, f string, h string"), ["k"], "f", "h").first()["fingerprint"]
    three = joins.fingerprint(spark.createDataFrame(rows[:-1], "k string, f string, h string"), ["k"], "f", "h").first()["fingerprint"]
    assert one == two != three


def test_contents_entries(spark):
    df = spark.createDataFrame([(1, 1, "Contents"), (1, 2, "1 First chapter"), (1, 3, "goes on ..... 12"), (1, 4, "2.1 Next .. 30")], "k long, i long, t string")
    assert [(r["title"], r["page"]) for r in layout.contents_entries(df, "k", "i", "t").orderBy("entry_no").collect()] == [("1 First chapter goes on", 12), ("2.1 Next", 30)]


def test_table_runs(spark):
    df = spark.createDataFrame([(1, 1, 3, 100.0), (1, 2, 3, 101.0), (1, 3, 4, 101.0), (1, 5, 4, 101.0)], "k long, page long, cols long, width double")
    assert [r["run_no"] for r in layout.table_runs(df, "k", "page", "cols", "width").orderBy("page").collect()] == [1, 1, 2, 3]


def test_ruled_cells(spark):
    lines = [(0, 30, 0, 0), (0, 30, 10, 10), (0, 30, 20, 20), (0, 0, 0, 20), (10, 10, 10, 20), (20, 20, 0, 20), (30, 30, 0, 20)]
    df = spark.createDataFrame([(1, *map(float, x)) for x in lines], "page long, x0 double, x1 double, top double, bottom double")
    got = {(r["row"], r["col"], r["rowspan"], r["colspan"]) for r in layout.ruled_cells(df, ["page"]).collect()}
    assert got == {(1, 1, 1, 2), (1, 3, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 1, 1)}
    assert layout.ruled_cells(df.limit(0), ["page"]).count() == 0


def test_interleavings():
    assert alignment.interleavings([["a", "b"], ["c"]], ["a", "c", "b"]) == 1
    assert alignment.interleavings([["a"], ["a"]], ["a", "a"]) == 2
    assert alignment.interleavings([["a"], ["b"]], ["b", "b"]) == 0


def test_restoration():
    source = "A well - known case — “ not ” a guess .".split()
    target = "A well known case - \" not \" a guess .".split()
    fixed = list(target)
    for at, old, new in sorted(alignment.restoration(source, target), reverse=True):
        fixed[at : at + (old != "")] = [new] if new else []
    assert fixed == source
    assert alignment.restoration(["a"], ["b"]) == []
