"""What is usual for a user: decayed hourly counts, and the hours and rates that depart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden.functions.skew import lookup_join

#: Hours that count as history, and after how many of them a count weighs half.
HISTORY_HOURS, HALF_LIFE_HOURS = 672, 168
#: Hours a user must have been seen before anything is unusual.
LEAST_HOURS = 24
#: An hour is unusual below this share of the user's activity, a count beyond so many times the rate and at least so large.
LEAST_SHARE, MOST_RATE, LEAST_EVENTS = 0.02, 3.0, 5


def hour_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")


def hourly_activity(logs: DataFrame, *, user: str = "user_name", time_col: str = "ts") -> DataFrame:
    """``user, hour, events`` of every hour with events; logs without a time are left out."""
    return logs.where(F.col(time_col).isNotNull()).groupBy(user, hour_number(F.col(time_col)).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def activity_baseline(hourly: DataFrame, *, user: str = "user_name") -> DataFrame:
    """Add ``expected`` events, ``hour_share`` and the flags ``frequency_anomaly`` and ``unusual_time``, all from earlier hours only.

    Counts weigh by ``2 ** (-age / HALF_LIFE_HOURS)`` back to ``HISTORY_HOURS``. The rate is their sum over the weights of all hours
    since the user was first seen; the share is that of the same hour of the day. A user has a row per hour, however many
    events there were, so ordering one user's rows is a small task.
    """
    base = hourly.agg(F.min("hour")).scalar()
    weight = F.pow(F.lit(2.0), (F.col("hour") - base) / F.lit(float(HALF_LIFE_HOURS)))
    own = Window.partitionBy(user).orderBy("hour")
    past = own.rangeBetween(-HISTORY_HOURS, -1)
    same = Window.partitionBy(user, F.pmod("hour", F.lit(24))).orderBy("hour").rangeBetween(-HISTORY_HOURS, -1)
    weighed = hourly.withColumn("_w", F.col("events") * weight)
    summed = weighed.select(
        user, "hour", "events", F.sum("_w").over(past).alias("_all"), F.sum("_w").over(same).alias("_same"),
        F.least(F.col("hour") - F.min("hour").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(HISTORY_HOURS)).alias("_n"),
    )
    step = 2.0 ** (-1 / HALF_LIFE_HOURS)
    # Weights of the last _n hours: step + step^2 + ...
    hours = F.lit(step) * (F.lit(1.0) - F.pow(F.lit(step), F.col("_n"))) / F.lit(1.0 - step)
    settled = F.col("_n") >= LEAST_HOURS
    measured = summed.withColumns({
        "expected": F.when(settled, F.coalesce(F.col("_all") / weight, F.lit(0.0)) / hours),
        "hour_share": F.when(settled, F.try_divide(F.coalesce("_same", F.lit(0.0)), F.col("_all"))),
    })
    return measured.withColumns({
        "frequency_anomaly": F.coalesce((F.col("events") >= LEAST_EVENTS) & (F.col("events") > F.col("expected") * MOST_RATE), F.lit(False)),
        "unusual_time": F.coalesce(F.col("hour_share") < LEAST_SHARE, F.lit(False)),
    }).drop("_all", "_same", "_n")


def flag_activity(logs: DataFrame, baseline: DataFrame, *, user: str = "user_name", time_col: str = "ts") -> DataFrame:
    """Add both flags to each log from a stored ``baseline``; false for a log whose user and hour it does not know."""
    flags = baseline.select(user, F.col("hour").alias("_hour"), "frequency_anomaly", "unusual_time")
    joined = lookup_join(logs.withColumn("_hour", hour_number(F.col(time_col))), flags, [user, "_hour"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("frequency_anomaly", "unusual_time")}).drop("_hour")
