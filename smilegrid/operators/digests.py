"""Comparing two large keyed tables without moving the rows that are equal.

Every row has a digest. Rows fall into ranges of their key's hash, and a range of both
tables is equal if its digests add up to nothing when one side counts negatively. Only a few
numbers per range and task are shuffled. Ranges that differ are cut into finer ones the same
way, and only the rows of finer ranges that differ are joined cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..plans.lineage import cut

#: Ranges of the first level, and finer ones in each; both bound what is broadcast or stored.
RANGES = 1024
SIGN, COARSE, FINE = "__sign", "__coarse", "__fine"
LOW = 0xFFFFFFFF


def numeric_cells(new: DataFrame, expected: DataFrame, keys: list[str]) -> list[str]:
    """Columns that are compared: numeric ones of the expected table that the new one has."""
    kinds = dict(expected.dtypes)
    return [c for c in expected.columns if c not in keys and c in new.columns and kinds[c] not in ("string", "boolean", "date")]


def _side(df: DataFrame, keys: list[str], cells: list[str], sign: int) -> DataFrame:
    """Keys as text, cells as doubles (NaN is missing, -0 is 0), and the row's ranges."""
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + F.lit(0.0))
    typed = df.select(*[F.col(f"`{k}`").cast("string").alias(k) for k in keys], *[number(c).alias(c) for c in cells])
    place = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    return typed.withColumns(
        {
            SIGN: F.lit(sign),
            COARSE: F.pmod(place, F.lit(RANGES)).cast("int"),
            FINE: F.pmod(F.shiftright(place, 32), F.lit(RANGES)).cast("int"),
        }
    )


def _digests(rows: DataFrame, keys: list[str], cells: list[str], ranges: list[str]) -> DataFrame:
    """One row per range: row counts of both sides and whether the range has to be looked into.

    A row with a missing key or an infinite cell never equals another one, so it marks its range.
    """
    named = [F.col(f"`{c}`") for c in (*keys, *cells)]
    # Hashes skip missing values, so their places are hashed too.
    parts = [*named, *[c.isNull() for c in named]]
    one, two = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    sign = F.col(SIGN)
    signed = lambda c: F.sum(sign * c) != 0
    apart = F.lit(False)
    for c in keys:
        apart = apart | F.col(f"`{c}`").isNull()
    for c in cells:
        apart = apart | N.holds(F.abs(F.col(f"`{c}`")) == float("inf"))
    high, low = F.shiftrightunsigned(one, 32), one.bitwiseAND(F.lit(LOW))
    differs = signed(F.lit(1)) | signed(high) | signed(low) | (F.bit_xor(two) != 0) | F.max(apart)
    return rows.groupBy(*ranges).agg(
        F.count_if(sign > 0).alias("n_new"), F.count_if(sign < 0).alias("n_expected"), differs.alias("differs")
    )


def _gap(new: Column, expected: Column, one_side: Column) -> Column:
    infinite = F.lit(float("inf"))
    return (
        F.when(one_side, infinite)
        .when(new.isNull() & expected.isNull(), 0.0)
        .when(N.finite(new) & N.finite(expected), F.abs(new - expected))
        .otherwise(infinite)
    )


def range_diff(new: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Verdicts of `checks.table_diff` for large tables: its row for the keys, one row that
    counts all cells, and a row for every cell that fails.

    `row_keys` holds the rows of both tables and the number of keys on one side only;
    `cells` the number of cells, of those that pass, and of those that fail. A null key
    matches nothing, missing cells are equal, infinite ones are not. Keys are meant to be
    unique (`checks.duplicate_keys`); repeated keys that both tables hold alike pass.
    """
    cells = numeric_cells(new, expected, keys)
    rows = _side(new, keys, cells, 1).unionByName(_side(expected, keys, cells, -1))
    coarse = cut(_digests(rows, keys, cells, [COARSE]))
    off = F.broadcast(coarse.where("differs").select(COARSE))  # at most RANGES rows
    suspects = rows.join(off, COARSE)
    fine = cut(_digests(suspects, keys, cells, [COARSE, FINE]))
    left_open = suspects.join(fine.where("differs").select(COARSE, FINE), [COARSE, FINE])

    k = [f"__k{i}" for i in range(len(keys))]
    c = [f"__c{i}" for i in range(len(cells))]

    def half(sign: int, prefix: str) -> DataFrame:
        named = [F.col(f"`{x}`").alias(y) for x, y in zip(keys, k)] + [F.col(f"`{x}`").alias(prefix + y) for x, y in zip(cells, c)]
        return left_open.where(F.col(SIGN) == sign).select(*named, F.lit(True).alias(prefix))

    both = half(1, "n").join(half(-1, "e"), k, "full")
    one_side = F.col("n").isNull() | F.col("e").isNull()
    key_text = F.concat_ws(";", *[F.concat(F.lit(x + "="), F.col(y)) for x, y in zip(keys, k)])
    each = [
        F.struct(
            F.concat(F.lit(x + "["), key_text, F.lit("]")).alias("result_name"),
            F.col("e" + y).alias("reference_value"),
            F.col("n" + y).alias("new_value"),
            _gap(F.col("n" + y), F.col("e" + y), one_side).alias("absolute_difference"),
        )
        for x, y in zip(cells, c)
    ]
    failing = F.filter(F.array(*each), lambda cell: cell["absolute_difference"] > tolerance) if each else F.array()
    opened = cut(both.select(F.col("n").isNotNull().alias("n"), F.col("e").isNotNull().alias("e"), failing.alias("failing")))

    total = coarse.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("new"), F.coalesce(F.sum("n_expected"), F.lit(0)).alias("expected"))
    seen = opened.agg(
        F.count_if(~(F.col("n") & F.col("e"))).alias("apart"),
        F.count_if("e").alias("opened"),
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum(F.size("failing")), F.lit(0)).alias("failed"),
    )
    counts = [*total.columns, *seen.columns]
    facts = total.unionByName(seen, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in counts])
    all_cells = (F.col("expected") - F.col("opened") + F.col("pairs")) * len(cells)
    line = lambda name, reference, value, gap: F.struct(
        F.lit(name).alias("result_name"),
        reference.cast("double").alias("reference_value"),
        value.cast("double").alias("new_value"),
        gap.cast("double").alias("absolute_difference"),
        F.lit(0.0).alias("tolerance"),
    )
    summary = facts.select(
        F.explode(
            F.array(
                line("row_keys", F.col("expected"), F.col("new"), F.col("apart")),
                line("cells", all_cells, all_cells - F.col("failed"), F.col("failed")),
            )
        ).alias("r")
    ).select("r.*")
    if not cells:
        return _judged(summary)
    detail = opened.select(F.explode("failing").alias("r")).select("r.*", F.lit(float(tolerance)).alias("tolerance"))
    return _judged(summary.unionByName(detail))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("absolute_difference") <= F.col("tolerance"), "PASS").otherwise("FAIL"))
