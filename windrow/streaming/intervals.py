"""Windows joined with the points in them while both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(windows: DataFrame, points: DataFrame, start: str, end: str, at: str, keys: list[str], *, longest: str, late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Rows of windows with the points in [start, end), of two streams or tables; start, end and at are timestamps.

    No window may be longer than longest: with both watermarks (late) this bounds how long a row can still find a partner,
    so Spark drops it from the state once the other stream is past that. Rows later than the watermark find none.
    how: left gives windows without points too, with nulls, once their time is over. Equal times of a window and a point
    match at its start and not at its end, as in the join of tables. Columns but the keys must differ.

    The join is by keys and bucket of time, so a row meets those of its bucket and not all that a key has in the state. A window is in
    the bucket of its start, and so once, a point in its own and the one before, as buckets are longer than any window (by an eighth: days
    and months differ in length).
    """
    if how not in ("inner", "left"):
        raise ValueError(f"inner or left, not {how}")
    mine, other = windows, points.withColumnsRenamed({k: f"_{k}" for k in keys})
    if windows.isStreaming:
        mine, other = mine.withWatermark(start, late), other.withWatermark(at, late)
    size = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {longest}"))
    bucket = lambda c: F.floor(F.unix_micros(F.col(c)) / (size * 9 / 8))
    mine = mine.withColumn("_mine", bucket(start))
    other = other.withColumn("_own", bucket(at)).withColumn("_bucket", F.explode(F.array(F.col("_own") - 1, F.col("_own")))).drop("_own")
    met = (F.col("_mine") == F.col("_bucket")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)) & (F.col(at) <= F.col(start) + F.expr(f"interval {longest}"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    return mine.join(other, met, "leftOuter" if how == "left" else "inner").drop("_mine", "_bucket", *[f"_{k}" for k in keys])
