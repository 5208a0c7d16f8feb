"""The closed-form repairs against a plain loop over every series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.operators import cleaning


def brute_force(values, multiplier=3.0):
    """Left to right, one value at a time; returns (cleaned, reasons)."""
    v = [math.nan if x is None else float(x) for x in values]
    reasons = [None] * len(v)

    def repaired(k):
        around = [v[j] for j in (k - 1, k + 1) if 0 <= j < len(v)]
        good = [x for x in around if not math.isnan(x) and x >= 0]
        return sum(good) / len(good) if good else 0.0

    for reason, bad in (("negative", lambda x: x < 0), ("missing", math.isnan)):
        for k in range(len(v)):
            if bad(v[k]):
                v[k], reasons[k] = repaired(k), reason
    steps = np.diff(v)
    if len(steps) > 3:
        q1, q3 = np.quantile(steps, [0.25, 0.75])
        low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        for k in range(1, len(v)):
            jump = v[k] - v[k - 1]
            if not low <= jump <= high and reasons[k] is None:
                v[k], reasons[k] = repaired(k), "outlier"
    return v, reasons


def random_series(rng, n):
    kind = rng.random()
    out = []
    for _ in range(n):
        r = rng.random()
        if r < 0.25 * kind:
            out.append(None)
        elif r < 0.5 * kind:
            out.append(-rng.randint(1, 50))
        elif r > 0.95:
            out.append(rng.randint(500, 2000))
        else:
            out.append(rng.randint(0, 100))
    return out


CASES = {
    "empty-ish": [None] * 12,
    "all negative": [-1, -2, -3, -4, -5, -6],
    "one": [5],
    "one bad": [-5],
    "two missing": [None, None],
    "run at start": [-1, -2, None, 8, 9, 10],
    "run at end": [8, 9, 10, None, -2, -1],
    "mixed run": [4, -1, None, -2, None, 8, 3, 3],
    "zeros": [0] * 24,
    "four": [1, 2, 100, 3],
    "equal to mean": [0, 100, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209],
    "two spikes": [10, 11, 10, 500, 510, 11, 10, 11, 10, 11, 12, 11],
}


@pytest.fixture(scope="module")
def cleaned(spark, long):
    rng = random.Random(7)
    series = dict(CASES) | {f"r{k}": random_series(rng, rng.randint(1, 60)) for k in range(300)}
    rows = cleaning.clean_all(long(series)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["product"], []).append(r)
    return series, {k: sorted(v, key=lambda r: r["i"]) for k, v in got.items()}


def test_matches_plain_loop(cleaned):
    series, got = cleaned
    assert set(got) == set(series)
    for name, values in series.items():
        want, reasons = brute_force(values)
        assert [r["reason"] for r in got[name]] == reasons, name
        assert [r["clean"] for r in got[name]] == pytest.approx(want, abs=1e-9), name


def test_change_log_and_counts(spark, long, cleaned):
    table = cleaning.clean_all(long(CASES))
    log = cleaning.change_log(table).collect()
    counts = {r["product"]: r for r in cleaning.change_counts(table).collect()}
    assert sum(r["n_total"] for r in counts.values()) == len(log)
    assert counts["all negative"]["n_negative"] == 6
    assert all(r["original"] is None for r in log if r["reason"] == "missing")
    assert all(r["original"] < 0 for r in log if r["reason"] == "negative")


def test_multiplier_widens_the_bounds(long):
    d = long({"a": CASES["two spikes"]})
    tight = cleaning.clean_all(d, 1.0).filter(F.col("reason") == "outlier").count()
    assert tight >= cleaning.clean_all(d, 1000.0).filter(F.col("reason") == "outlier").count() == 0
