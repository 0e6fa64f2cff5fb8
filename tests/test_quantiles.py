"""Quantiles of groups against numpy, on ties, hot and tiny groups, outliers and odd values."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators.quantiles import quantiles

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


def test_quantiles(spark):
    rng = random.Random(4)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(9000)], "ties": [rng.choice((1.0, 2.0, 2.0, 7.5)) for _ in range(900)], "one": [3.0], "two": [1.0, 4.0], None: [rng.expovariate(1e-3) for _ in range(500)], "wide": [1e308, -1e308, 1e-300, 0.0, -0.0, 5e-324, 1.0, 1 + 2**-52],
        "skew": [1e300, *[rng.random() for _ in range(700)]], "odd": [math.nan, math.inf, None, 2.0, 1.0], "none": [None, math.nan],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles(df, ["g"], F.col("v"), SHARES).collect()}
    near = {r.g: r for r in quantiles(df, ["g"], F.col("v"), SHARES, nearest=True).collect()}
    assert set(got) == set(near) == set(groups) - {"none"}
    for g, vs in groups.items():
        known = sorted(v for v in vs if v is not None and math.isfinite(v))
        for name, p in SHARES.items() if known else ():
            assert near[g][name] == known[max(0, math.ceil(len(known) * p) - 1)] and got[g]._n == len(known)
            want = float(np.quantile(known, p)) if g != "wide" else None
            assert want is None or math.isclose(got[g][name], want, rel_tol=1e-12, abs_tol=1e-300), (g, name)


def test_all_rows_and_none(spark):
    df = spark.range(2001).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in quantiles(df, [], F.col("v"), {"m": 0.5, "q": 0.0003}).collect()] == [(2001, 1000.0, 0.6)]
    assert quantiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], F.col("v"), {"m": 0.5}).count() == 0
