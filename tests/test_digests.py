"""Range digests against the cell-by-cell comparison."""

import math
import random

import pytest

from smilegrid.operators import checks, digests

SCHEMA = "k long, day string, x double, y double, name string"


def table(n, seed):
    rng = random.Random(seed)
    return [(i, f"2024-01-{i % 28 + 1:02d}", rng.uniform(-1, 1), None if i % 7 == 0 else rng.uniform(0, 9), f"n{i}") for i in range(n)]


def compare(spark, a, b, tolerance=1e-10):
    new, expected = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    found = {r.result_name: r for r in digests.range_diff(new, expected, ["k", "day"], tolerance).collect()}
    plain = {r.result_name: r for r in checks.table_diff(new, expected, ["k", "day"], tolerance).collect()}
    return found, plain


def same_verdicts(found, plain):
    failing = {k: r for k, r in plain.items() if r.status == "FAIL" and k != "row_keys"}
    assert {k for k in found if k not in ("row_keys", "cells")} == failing.keys()
    for k, r in failing.items():
        f = found[k]
        missing = lambda v: None if v is None or math.isnan(v) else v  # the digests' side shows NaN as missing
        assert (f.reference_value, f.new_value, f.status) == (missing(r.reference_value), missing(r.new_value), "FAIL")
        assert f.absolute_difference == r.absolute_difference
    assert found["row_keys"] == plain["row_keys"]
    assert (found["cells"].reference_value, found["cells"].absolute_difference) == (len(plain) - 1, len(failing))


def test_changed_cells_keys_and_patterns(spark):
    a = table(3000, 1)
    b = [list(r) for r in a]
    for i in range(0, 3000, 97):
        b[i][2] += 1.0  # a changed cell
    for i in range(50, 3000, 311):
        b[i][2] += 1e-13  # within the tolerance
    for i in (7, 14):
        b[i][3] = 4.0  # missing on one side
    b[20][2], b[21][2] = math.inf, -math.inf
    b[22][2] = math.nan
    del b[1000]
    b.append([5000, "2024-02-01", 1.0, 2.0, "only here"])
    b[30][4] = "text columns are not compared"
    same_verdicts(*compare(spark, a, [tuple(r) for r in b]))


def test_missing_infinite_and_signed_zero(spark):
    a = [(1, "d", math.nan, None, "a"), (2, "d", 0.0, None, "a"), (3, "d", math.inf, 1.0, "a"), (4, "d", None, 2.0, "a")]
    b = [(1, "d", None, math.nan, "a"), (2, "d", -0.0, None, "a"), (3, "d", math.inf, 1.0, "a"), (4, "d", 2.0, None, "a")]
    found, plain = compare(spark, a, b)
    same_verdicts(found, plain)
    assert {k for k in found if "[" in k} == {"x[k=3;day=d]", "x[k=4;day=d]", "y[k=4;day=d]"}


def test_equal_and_empty_tables(spark):
    a = table(500, 2)
    found, plain = compare(spark, a, list(reversed(a)))
    same_verdicts(found, plain)
    assert set(found) == {"row_keys", "cells"} and {r.status for r in found.values()} == {"PASS"}
    found, plain = compare(spark, [], [])
    assert [found[k].reference_value for k in ("row_keys", "cells")] == [0, 0]
    same_verdicts(*compare(spark, a[:3], []))
    same_verdicts(*compare(spark, [], a[:3]))


def test_null_keys_match_nothing_and_equal_repeats_pass(spark):
    odd = [(None, "d", 1.0, 2.0, "a")]
    found, plain = compare(spark, odd, odd)
    assert found["row_keys"].absolute_difference == plain["row_keys"].absolute_difference == 2
    twice = [(1, "d", 1.0, 2.0, "a"), (1, "d", 3.0, 2.0, "a")]
    found, _ = compare(spark, twice, twice)
    assert {r.status for r in found.values()} == {"PASS"}


def test_swapped_values_between_rows_and_columns_are_seen(spark):
    a = [(1, "d", 1.0, 2.0, "a"), (2, "d", 3.0, 4.0, "a"), (3, "d", None, 5.0, "a")]
    b = [(1, "d", 3.0, 2.0, "a"), (2, "d", 1.0, 4.0, "a"), (3, "d", 5.0, None, "a")]
    same_verdicts(*compare(spark, a, b))


def test_clashing_column_names(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "`e` int, `n` double, `a b.c` double")
    b = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.5)], "`e` int, `n` double, `a b.c` double")
    found = {r.result_name: r.absolute_difference for r in digests.range_diff(a, b, ["e"]).collect()}
    assert found == {"row_keys": 0.0, "cells": 1.0, "a b.c[e=2]": 0.5}


def test_equal_tables_move_only_digests(spark):
    """Shuffled bytes of two equal tables do not grow with their rows."""
    frames = {n: spark.range(n).selectExpr("id AS k", "id * 0.5D AS x", "repeat('z', 50) AS name") for n in (20_000, 200_000)}
    moved = {}
    for n, df in frames.items():
        rows = digests._side(df, ["k"], ["x"], 1).unionByName(digests._side(df, ["k"], ["x"], -1))
        coarse = digests._digests(rows, ["k"], ["x"], [digests.COARSE])
        assert coarse.where("differs").isEmpty()
        moved[n] = coarse.count()
    assert set(moved.values()) == {digests.RANGES}


@pytest.mark.parametrize("kind", ["int", "decimal(12,2)", "float"])
def test_kinds_of_numbers(spark, kind):
    a = spark.range(40).selectExpr("id AS k", f"CAST(id AS {kind}) AS x")
    b = spark.range(40).selectExpr("id AS k", f"CAST(id + IF(id = 9, 1, 0) AS {kind}) AS x")
    found = {r.result_name: r.status for r in digests.range_diff(a, b, ["k"]).collect()}
    assert found == {"row_keys": "PASS", "cells": "FAIL", "x[k=9]": "FAIL"}
