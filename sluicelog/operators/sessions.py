"""Sessions by start-end pairing.

Two events of one key less than or exactly ``gap`` apart are of one session.
Times are first folded into slots as wide as the gap: all events of a slot are
of one session, so a slot is known by its first and last time and its count,
and a key with any number of events has at most one row a slot. A RANGE frame
over the slot before (after) tells whether a gap-near predecessor (successor)
exists; slots without are starts (ends). Starts and ends are numbered
separately, equal numbers are joined, and the count is the difference of the
running counts at either side.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workdir import materialize


def row_hash(columns: list[Column]) -> Column:
    """A 64-bit hash that tells NULL in one column from NULL in another."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def distinct_events(df: DataFrame, key: str, time_ms: Column, same: list[str]) -> DataFrame:
    """``key, time_ms`` once for each set of rows equal in ``same`` (which must cover both).

    The key and the time are compared exactly, the other columns by a 64-bit
    hash within that key and time.
    """
    rest = [F.col(c) for c in same if c != key]
    return df.select(F.col(key).alias("key"), time_ms.cast("long").alias("time_ms"), row_hash(rest).alias("_row")).distinct().drop("_row")


def sessionize(events: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions of ``key, time_ms`` events: ``key, session_no, start_ms, end_ms, n_events``.

    A new session starts with an event more than ``gap_ms`` after the one
    before of its key. Events at the same time are all counted; the NULL key is
    a key like any other; an event without a time belongs to no session and is
    left out. ``session_no`` counts from 1 in each key by time. No events, no
    sessions. Rows per key after folding are bounded by the covered time
    divided by the gap, whatever the number of events.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms must be positive")
    slots = (
        events.where(F.col("time_ms").isNotNull())
        .groupBy("key", _slot(F.col("time_ms"), gap_ms).alias("slot"))
        .agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    by_slot = Window.partitionBy("key").orderBy("slot")
    flagged = slots.select(
        "key",
        "lo",
        "hi",
        F.coalesce(F.col("lo") - F.max("hi").over(by_slot.rangeBetween(-1, -1)) > gap_ms, F.lit(True)).alias("is_start"),
        F.coalesce(F.min("lo").over(by_slot.rangeBetween(1, 1)) - F.col("hi") > gap_ms, F.lit(True)).alias("is_end"),
        F.sum("n").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        "n",
        "slot",
    )
    running = by_slot.rowsBetween(Window.unboundedPreceding, 0)
    ranked = flagged.select(
        "*",
        F.sum(F.col("is_start").cast("long")).over(running).alias("start_no"),
        F.sum(F.col("is_end").cast("long")).over(running).alias("end_no"),
    )
    starts = ranked.where("is_start").select(F.col("key").alias("_key"), F.col("start_no").alias("session_no"), F.col("lo").alias("start_ms"), (F.col("upto") - F.col("n")).alias("_before"))
    ends = ranked.where("is_end").select("key", F.col("end_no").alias("_no"), F.col("hi").alias("end_ms"), "upto")
    return starts.join(ends, F.col("_key").eqNullSafe(F.col("key")) & (F.col("session_no") == F.col("_no"))).select(
        "key", "session_no", "start_ms", "end_ms", (F.col("upto") - F.col("_before")).alias("n_events")
    )


def _slot(time_ms: Column, gap_ms: int) -> Column:
    """Floor division in whole numbers, also before 1970."""
    return F.call_function("div", time_ms - F.pmod(time_ms, F.lit(gap_ms).cast("long")), F.lit(gap_ms).cast("long"))


def distinct_per_session(values: DataFrame, sessions: DataFrame, column: str, gap_ms: int) -> DataFrame:
    """``sessions`` with ``n_values``, the number of different non-NULL values of ``column`` in each.

    ``values`` has ``key``, ``time_ms`` and ``column``. All events of a slot are
    of one session, so values are reduced to one a slot before they meet the
    sessions. A session is joined by the slots it covers, found by an equal
    (key, slot) after both sides name each slot; a slot at most touches the end
    of one session, and events of a slot are of the same session. The sessions
    are written to the shared folder when this is called, since two sides of
    the plan read them.
    """
    sessions = materialize(sessions, "sessions")
    per_slot = (
        values.where(F.col(column).isNotNull() & F.col("time_ms").isNotNull())
        .select("key", _slot(F.col("time_ms"), gap_ms).alias("slot"), F.col(column).alias("_value"))
        .distinct()
    )
    covered = sessions.select(
        F.col("key").alias("_key"), "session_no", F.explode(F.sequence(_slot(F.col("start_ms"), gap_ms), _slot(F.col("end_ms"), gap_ms))).alias("_slot")
    )
    seen = (
        per_slot.join(covered, F.col("key").eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot")))
        .select("_key", "session_no", "_value")
        .distinct()
        .groupBy("_key", "session_no")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .withColumnRenamed("session_no", "_no")
    )
    joined = sessions.join(seen, F.col("key").eqNullSafe(F.col("_key")) & (F.col("session_no") == F.col("_no")), "left")
    return joined.select(*sessions.columns, F.coalesce("n_values", F.lit(0)).alias("n_values"))
