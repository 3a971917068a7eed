"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic, so each map task folds its rows into one
state per key (a hash table that spills when full) and only those states are
shuffled: a key with a third of all rows costs the reducer one state per map
task, no more than a rare key that occurs in as many tasks.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, fields: Mapping[str, Column], time: Column | None = None) -> DataFrame:
    """Rows, first and last time of every key of every field, in one scan.

    Returns ``field, key_value, n_rows, first_time, last_time``; the key NULL
    has a row of its own, so the counts of a field add up to all rows. ``time``
    may be None (then both times are NULL) and NULL times are ignored. An empty
    table gives no rows; repeated rows count as often as they occur. Columns
    named like the result's do no harm, since expressions are taken first.
    """
    when = F.lit(None).cast("double") if time is None else time.cast("double")
    cells = F.array(*[F.struct(F.lit(name).alias("field"), key.cast("string").alias("key_value")) for name, key in fields.items()])
    return (
        df.select(when.alias("_time"), F.explode(cells).alias("_cell"))
        .groupBy("_cell.field", "_cell.key_value")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("_time").alias("first_time"), F.max("_time").alias("last_time"))
    )


def heavy_keys(counts: DataFrame, share_permille: int) -> DataFrame:
    """The keys that hold at least ``share_permille`` / 1000 of all rows of their field.

    ``counts`` is a result of ``per_key``. The totals, one row a field, come
    from the same shuffled states and are the only data broadcast. NULL is
    counted in the total but is no key. Bounds are compared in whole numbers.
    """
    totals = counts.groupBy("field").agg(F.sum("n_rows").alias("_total"))
    # asked of the count as well, the test stays above the aggregate, and both readers share its shuffle
    is_key = F.when(F.col("n_rows") > 0, F.col("key_value")).isNotNull()
    return counts.join(F.broadcast(totals), "field").where(is_key & (F.col("n_rows") * 1000 >= F.col("_total") * share_permille)).drop("_total")
