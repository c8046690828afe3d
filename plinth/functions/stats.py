"""Statistics that SQL's own differ from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """A rounded ratio, 0 where the divisor is 0 or null."""
    return F.coalesce(F.round(F.try_divide(top, bottom), digits), F.lit(0.0))


#: Slices that the values of a group are cut into.
SLICES = 64


def exclusive_quantiles(df: DataFrame, keys: list[str], value: str, percents: list[int], digits: int = 4) -> DataFrame:
    """Quantiles by the exclusive method: position ``p (n + 1) / 100`` among the sorted values, beyond the ends by extrapolation.

    One value: itself. Null values are left out; a group of none has no row. Exact: approximate quantiles only cut each group into SLICES, whose
    counts say in which of them the wanted ranks lie; those alone are sorted, so no task holds a group. Many equal values make one slice, whose
    rows are all alike, so it is counted by value before it is ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__x", [k / SLICES for k in range(1, SLICES)], 1000).alias("__cuts"), F.count("*").alias("__n"))
    n = F.col("__n")
    place = {p: F.least(F.greatest(F.floor(F.lit(p) * (n + 1) / 100), F.lit(1)), F.greatest(n - 1, F.lit(1))) for p in percents}
    cuts = cuts.withColumn("__ranks", F.array_distinct(F.flatten(F.array(*(F.array(j, F.least(j + 1, n)) for j in place.values())))))
    sliced = rows.groupBy(*keys, "__x").agg(F.count("*").alias("__c")).join(cuts.select(*keys, "__cuts"), keys)
    sliced = sliced.select(*keys, "__x", "__c", F.size(F.filter("__cuts", lambda c: c < F.col("__x"))).alias("__s"))
    sizes = sliced.groupBy(*keys, "__s").agg(F.sum("__c").alias("__size"))
    sizes = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*keys).orderBy("__s")) - F.col("__size"))
    wanted = sizes.join(cuts.select(*keys, "__n", "__ranks"), keys)
    wanted = wanted.withColumn("__ranks", F.filter("__ranks", lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__size")))).where(F.size("__ranks") > 0)
    near = sliced.join(wanted.select(*keys, "__s", "__before", "__n", "__ranks"), [*keys, "__s"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__s").orderBy("__x"))
    ranked = near.withColumn("__to", upto).withColumn("__r", F.explode(F.filter("__ranks", lambda r: (r > F.col("__to") - F.col("__c")) & (r <= F.col("__to")))))
    aggs = []
    for p, j in place.items():
        share = F.lit(p) * (n + 1) - j * 100
        weight = F.when(n == 1, 100.0).when(F.col("__r") == j, 100.0 - share).when(F.col("__r") == j + 1, share + F.lit(0.0))
        aggs.append(F.round(F.sum(weight * F.col("__x")) / 100, digits).alias(f"p{p}"))
    return ranked.groupBy(*keys).agg(*aggs)
