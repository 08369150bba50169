"""Exact order statistics of hot groups: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def beside(rows: DataFrame, small: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """``rows`` joined with a table of one row a key: sent to all tasks if it has ``most`` rows at most, else shuffled, where adaptive
    execution splits the rows of a hot key."""
    few = small.limit(most + 1).count() <= most
    return rows.join(F.broadcast(small) if few else small, by)


def _scale(x):
    """Grows with x as its logarithm does, on both sides of 0; never falls where x doesn't."""
    return F.signum(x) * F.when(x == 0, F.lit(0.0)).otherwise(F.ln(F.abs(x)) + 745)


def _step(v, low, high, buckets: int):
    """Which of the buckets from low to high holds v; 0 where they can't be told apart."""
    span = high - low
    part = F.when(span < F.lit(float("inf")), (v - low) / F.nullif(span, F.lit(0.0))).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    return F.coalesce(F.least(F.lit(buckets - 1), F.floor(part * buckets).cast("int")), F.lit(0))


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, buckets: int = 512, few: int = 4096, out: str = "quantile") -> DataFrame:
    """by, out: the quantile of each group, with linear interpolation between the two values at its place.

    Histograms are counted where the rows lie, by turns of equal steps and of equal steps of the logarithm. The bucket
    with the place sought is cut again, from its least to its greatest value, until ``few`` values are left, which are
    gathered. A pass narrows it by the number of buckets, so one or two do for most data. Nulls, NaN and infinities don't
    count; groups without values are left out.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    rows = cut(df.select(*by, F.col(value).cast("double").alias("__v")).where("abs(__v) < double('infinity')"))
    at = (F.col("__n") - 1) * F.lit(float(q))
    # low and high: the bounds within which the place k is sought, counted from low; next: the least value over high
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    state = state.withColumn("__part", at - F.floor(at)).withColumn("__k", F.floor(at).cast("long")).withColumn("__next", F.lit(None).cast("double"))
    state, done, turn = cut(state), None, 0
    while True:
        same, small = F.col("__low") == F.col("__high"), F.col("__n") <= few
        alike = state.where(same).withColumn("__first", F.col("__low"))
        alike = alike.withColumn("__after", F.when(F.col("__k") + 1 < F.col("__n"), F.col("__low")).otherwise(F.col("__next")))
        within = lambda part: beside(rows, part.select(*by, "__low", "__high"), by).where("__v between __low and __high")
        lists = within(state.where(~same & small)).groupBy(*by).agg(F.sort_array(F.collect_list("__v")).alias("__l"))
        ends = state.where(~same & small).join(lists, by)
        ends = ends.withColumn("__first", F.get("__l", F.col("__k"))).withColumn("__after", F.coalesce(F.get("__l", F.col("__k") + 1), "__next"))
        found = alike.select(*by, "__part", "__first", "__after").unionByName(ends.select(*by, "__part", "__first", "__after"))
        first, after = F.col("__first"), F.coalesce("__after", "__first")
        mid = F.when((F.col("__part") == 0) | (first == after), first).otherwise(first + F.col("__part") * (after - first))
        ready = found.select(*by, mid.alias(out))
        done = ready if done is None else done.unionByName(ready)
        state = state.where(~same & ~small)
        if state.isEmpty():
            return done
        v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
        step = _step(v, low, high, buckets) if turn % 2 == 0 else _step(_scale(v), _scale(low), _scale(high), buckets)
        hist = within(state).withColumn("__b", step).groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        order = Window.partitionBy(*by).orderBy("__b")  # at most ``buckets`` rows a key
        hist = hist.withColumn("__before", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
        hist = hist.withColumn("__then", F.lead("__lo").over(order))
        hit = state.join(hist, by).where((F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__before") + F.col("__c")))
        bounds = [F.col("__c").alias("__n"), F.col("__lo").alias("__low"), F.col("__hi").alias("__high")]
        state = cut(hit.select(*by, *bounds, "__part", (F.col("__k") - F.col("__before")).alias("__k"), F.coalesce("__then", "__next").alias("__next")))
        turn += 1
