"""Reproducible sums against Python's fsum, and trends whose time column is found by header."""

import math
import random
import struct

from pyspark.sql import functions as F

from gridweave.operators import exact
from gridweave.operators import metrics as M


def test_sums_are_those_of_fsum_for_any_partitions(spark, make):
    rng = random.Random(5)
    groups = {
        "cancel": [1e16, 1.0, -1e16],
        "negative": [-1e16, -1.0, 1e16, 2.0**-60],
        "minus_one": [2.0**90, -1.0, -(2.0**90)],
        "edges": [2.0**k for k in (-24, -1, 0, 24, 48, 72)] + [-(2.0**24) + 1, 2.0**48 - 1],
        "tie": [2.0**53, 1.0],
        "above_tie": [2.0**53, 1.0, 2.0**-200],
        "wide": [math.ldexp(rng.uniform(-1, 1), rng.randint(-900, 900)) for _ in range(300)],
        "money": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(2000)],
        "zero": [0.0, -0.0],
        "large": [1.7e308, -1.7e308, 1.7e308],
        "small": [5e-324, 5e-324, 1e-310],
    }
    rows = [(g, v, i) for g, vs in groups.items() for i, v in enumerate(vs)]
    for parts in (1, 7):
        rng.shuffle(rows)
        df = make(rows, "g string, v double, i int").repartition(parts)
        got = {r["g"]: (r["sum"], r["count"], r["lo"], r["hi"]) for r in exact.sums(df, ["g"], "v", least={"lo": "v"}, most={"hi": "i"}).collect()}
        for g, vs in groups.items():
            assert struct.pack("d", got[g][0] + 0.0) == struct.pack("d", math.fsum(vs) + 0.0), g
            assert got[g][1:] == (len(vs), min(vs), len(vs) - 1)


def test_nulls_and_what_is_no_number(spark, make):
    inf, nan = float("inf"), float("nan")
    rows = [("n", None), ("n", 2.5), ("none", None), ("inf", inf), ("inf", 1.0), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 1.0)]
    got = {r["g"]: (r["sum"], r["count"]) for r in exact.sums(make(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["n"] == (2.5, 1) and got["none"] == (None, 0) and got["inf"] == (inf, 2)
    assert math.isnan(got["both"][0]) and math.isnan(got["nan"][0])
    assert exact.sums(make([], "g string, v double"), ["g"], "v").count() == 0


def test_one_shuffle_of_bins_and_no_python(spark, make):
    plan = exact.sums(make([("a", 1.0)], "g string, v double"), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("partial_sum(part") == 1


def test_trend_finds_its_time_column(spark, make):
    rows = [("s", 1, "1月", 10.0, 1.0), ("s", 2, "2月", 15.0, 1.0), ("s", 3, None, 99.0, 1.0), ("s", 4, "", 98.0, 1.0)]
    values = {"v": F.col("v")}
    sheet = make(rows, "sheet string, row_idx int, `月份` string, v double, x double")
    got = [(r["column"], r["metric"], r["value"]) for r in M.trend(sheet, ["sheet"], values, "row_idx", None, ["mom"]).collect()]
    assert got == [("v", "mom", 0.5)]
    assert M.trend(sheet.drop("月份"), ["sheet"], values, "row_idx", None, ["mom"]).count() == 0
    assert M.time_column(["a", " Year "]) == " Year " and M.time_column(["v"]) is None
