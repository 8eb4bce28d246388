import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mix, pack

# 6


def test_best_fit_and_search():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 90) for _ in range(500)]
    bins = pack.best_fit(sizes, 100)
    better = pack.improve([list(b) for b in bins], sizes, 100)
    assert sorted(i for b in better for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in better)
    squares = lambda x: sum(sum(sizes[i] for i in b) ** 2 for b in x)
    assert squares(better) >= squares(bins) and len(better) <= len(bins)


def test_search_empties_a_bin():
    sizes = [6, 4, 5, 5]
    assert len(pack.improve([[0], [2], [1], [3]], sizes, 10)) == 2


def test_search_is_at_a_local_optimum_and_empties_bins():
    rng = random.Random(8)
    emptied = 0
    for _ in range(60):
        sizes = [rng.randrange(20, 70) for _ in range(40)]
        start = [[i, i + 20] if sizes[i] + sizes[i + 20] <= 100 else [i] for i in range(20)]
        start += [[i + 20] for i in range(20) if sizes[i] + sizes[i + 20] > 100]
        got = pack.improve(start, sizes, 100)
        emptied += len(start) - len(got)
        fill = [sum(sizes[i] for i in b) for b in got]
        assert sorted(i for b in got for i in b) == list(range(40)) and max(fill) <= 100
        for a in range(len(got)):  # brute force: no move or exchange raises the squares
            for b in range(len(got)):
                if a != b and fill[a] < 100:
                    for x in (0, *(sizes[i] for i in got[a])):
                        for y in (*((sizes[i],) for i in got[b]), *((sizes[i], sizes[j]) for i in got[b] for j in got[b] if i < j)):
                            d = sum(y) - x
                            assert not (0 < d <= 100 - fill[a] and d > fill[b] - fill[a])
    assert emptied > 60


def test_two_for_one():
    sizes = [50, 40, 30, 29, 31]  # 50 + 40 takes 30 + 29 for 50
    got = pack.improve([[0, 1], [2, 3, 4]], sizes, 99)
    assert sorted(sum(sizes[i] for i in b) for b in got) == [81, 99]


def test_fill_containers(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 3000)) for i in range(400)] + [(400, 0), (401, None), (402, -5), (None, 7), (5, 10), (403, 4096)]
    items = spark.createDataFrame(rows, "item long, size long").withColumn("part", F.lit("x")).withColumn("container", F.lit(1))
    caps = spark.createDataFrame([(1, 1000), (2, 5000)], "pack_id int, capacity_tokens long")
    got = pack.fill_containers(items, caps).collect()
    total = sum(max(0, s or 0) for _, s in rows)
    for p, c in ((1, 1000), (2, 5000)):
        own = [r for r in got if r["pack_id"] == p]
        bins = {}
        for r in own:
            bins[r["container"]] = bins.get(r["container"], 0) + r["size"]
        assert sum(bins.values()) == total and max(bins.values()) <= c
        assert total / (len(bins) * c) > 0.95
        cut = {r["item"] for r in own if r["part"] > 1}
        assert cut == {i for i, s in rows if (s or 0) > c}
    assert pack.fill_containers(items.limit(0), caps).count() == 0
    assert pack.fill_containers(items, caps.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack.fill_containers(items, spark.createDataFrame([(1, 0)], "pack_id int, capacity_tokens long"))


def test_ties(spark):
    items = spark.createDataFrame([(i, 10) for i in range(100)], "item long, size long")
    got = pack.fill_containers(items, spark.createDataFrame([(1, 30)], "pack_id int, capacity_tokens long"))
    assert got.select("container").distinct().count() == 34


# 7


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        rest = rng.random(rng.integers(1, 40))
        want = rest.sum()
        out, held = mix.pivot(rest, rng.random((8, len(rest))))
        assert out.sum() + (rest[held] if held >= 0 else 0) == pytest.approx(want)


def test_pivot_keeps_the_chances():
    rng = np.random.default_rng(2)
    p = np.array([0.2, 0.5, 0.8, 0.3, 0.2])
    hits = np.zeros(5)
    for _ in range(20_000):
        rest = p.copy()
        out, held = mix.pivot(rest, rng.random((5, 5)))
        if held >= 0:
            out[held] += rng.random() < rest[held]
        hits += out
    assert np.abs(hits / 20_000 - p).max() < 0.02


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab"), rng.randrange(50, 150)) for i in range(3000)] + [(9001, None, 500), (None, "a", 5), (9002, "b", None), (1, "a", 100)]
    items = spark.createDataFrame(rows, "item long, source string, size long").repartition(7).withColumn("copies", F.lit("x"))
    targets = spark.createDataFrame([(1, "a", 0.5, 3), (1, "b", 0.45, 2), (1, "gone", 0.05, 9), (2, "b", 0.9, 2)], "mix_id int, source string, target_weight double, max_repeats int")
    report = {(r["mix_id"], r["source"]): r for r in mix.mix_report(items, targets).collect()}
    for r in report.values():
        assert r["most_copies"] <= r["max_repeats"]
    assert report[1, "a"]["reached_tokens"] == pytest.approx(report[1, "a"]["target_tokens"], rel=0.01)
    assert report[1, "b"]["reached_tokens"] == pytest.approx(report[1, "b"]["target_tokens"], rel=0.01)
    assert report[1, "gone"]["falls_short"] and report[1, "gone"]["reached_tokens"] == 0
    b = sum(s or 0 for _, x, s in rows if x == "b")
    assert report[2, "b"]["falls_short"] and report[2, "b"]["reached_tokens"] == 2 * b
    again = {(r["mix_id"], r["source"]): r["reached_tokens"] for r in mix.mix_report(items, targets).collect()}
    assert again == {k: r["reached_tokens"] for k, r in report.items()}


def test_mix_empty(spark):
    items = spark.createDataFrame([], "item long, source string, size long")
    targets = spark.createDataFrame([(1, "a", 1.0, 1)], "mix_id int, source string, target_weight double, max_repeats int")
    copies, plan = mix.mix_sources(items, targets)
    assert copies.count() == 0 and plan.count() == 1
    copies, plan = mix.mix_sources(items, targets.limit(0))
    assert copies.count() == 0 and plan.count() == 0
