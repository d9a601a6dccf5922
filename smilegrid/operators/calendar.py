"""Exchange sessions: target dates, snapshot guards and the dense session panel.

A calendar has one row per session, so its windows are bounded by the number of
trading days and not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import holds
from ..functions.sizing import small_side


def calendar_table(sessions: DataFrame) -> DataFrame:
    """Number the sessions and mark those still open at the 15:45 snapshot.

    `sessions` has `session` and either `close_ts` (exchange-local close) or a
    ready `is_1545_open` flag.
    """
    df = sessions
    if "is_1545_open" not in df.columns:
        minute = F.hour("close_ts") * 60 + F.minute("close_ts")
        df = df.withColumn("is_1545_open", holds(minute >= 15 * 60 + 45))
    return df.withColumn("session_no", F.row_number().over(Window.orderBy("session")) - 1)


def with_targets(calendar: DataFrame, horizons=(1, 2)) -> DataFrame:
    """The h-th next session and its weekday (Monday = 0) beside each session."""
    order = Window.orderBy("session")
    ahead = {h: F.lead("session", h).over(order) for h in horizons}
    columns = {f"target_h{h}": c for h, c in ahead.items()}
    columns |= {f"dow_h{h}": F.weekday(c).cast("double") for h, c in ahead.items()}
    return calendar.withColumns(columns)


def snapshot_guard(df: DataFrame, date: str, calendar: DataFrame, name: str = "calendar_guard_pass") -> DataFrame:
    """TRUE where the date is a session open at the snapshot; other dates are FALSE."""
    side = small_side(calendar.select(F.col("session").alias(date), F.col("is_1545_open").alias(name)))
    return df.join(side, date, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def chronology(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Decision on a session, entry and exit on sessions open at the snapshot. Only
    dates are consulted, so prices and outcomes cannot move eligibility."""
    sessions = small_side(
        calendar.select(F.col("session").alias("decision_date"), F.lit(True).alias("decision_session"))
    )
    out = df.join(sessions, "decision_date", "left").withColumn(
        "decision_session", F.coalesce("decision_session", F.lit(False))
    )
    out = snapshot_guard(out, "entry_date", calendar, "entry_snapshot_session")
    out = snapshot_guard(out, "intended_exit_date", calendar, "exit_snapshot_session")
    return out.withColumn(
        "economic_calendar_eligible",
        F.col("decision_session") & F.col("entry_snapshot_session") & F.col("exit_snapshot_session"),
    )


def densify(surface: DataFrame, calendar: DataFrame, nodes: DataFrame, day: str = "quote_date") -> DataFrame:
    """Every session for every node; missing observations stay NULL.

    Each node row carries the session list (bounded by the calendar) and is
    exploded, which spreads by node without a join over all pairs.
    """
    sessions = calendar.agg(
        F.array_sort(F.collect_list(F.struct("session", "session_no"))).alias("_sessions")
    ).withColumn("_one", F.lit(1))
    full = (
        nodes.withColumn("_one", F.lit(1))
        .join(F.broadcast(sessions), "_one")  # a single row holding the calendar
        .select(*nodes.columns, F.inline("_sessions"))
        .withColumnRenamed("session", day)
    )
    return full.join(surface.select(day, "node", "iv_grid"), [day, "node"], "left")
