"""Ranks, running sums and quantiles over whole tables, without a window that holds a whole key or the whole table.

Rows are range-partitioned by key and order, so a key may span many partitions. Sums run within partitions; what lies
before a partition comes from one row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.session import cut_lineage


def running_sums(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """``df`` with ``<v>_upto`` and ``<v>_all`` for each of ``values``: the sums over the key's rows up to this one in
    ``order``, which is unique within a key, and over all of them."""
    d = cut_lineage(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # One row per partition and key: at most partitions + keys.
    totals = d.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    keys = [F.col(b).alias(f"_k_{b}") for b in by]
    sums = [(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}"), F.sum(f"_t_{v}").over(W.partitionBy(*by)).alias(f"_a_{v}")) for v in values]
    totals = totals.select(*keys, F.col("_part").alias("_p"), *(c for pair in sums for c in pair))
    d = d.withColumns({f"_i_{v}": F.sum(v).over(inside) for v in values})
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    out = d.join(totals, same)
    return out.select(*df.columns, *((F.col(f"_i_{v}") + F.col(f"_b_{v}")).alias(f"{v}_upto") for v in values), *(F.col(f"_a_{v}").alias(f"{v}_all") for v in values))


def row_numbers(df: DataFrame, order: list[Column], by: list[str], name: str = "n") -> DataFrame:
    """``df`` with the number, from 1, of each row within its key, in ``order``: a global sort numbers all rows, from which
    the number before the key's first row is taken."""
    d = cut_lineage(df.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))  # one row per partition
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_b")
    d = d.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_g", F.col("_b") + F.col("_id").bitwiseAND((1 << 33) - 1))
    if by:
        first = d.groupBy(*(F.col(b).alias(f"_k_{b}") for b in by)).agg(F.min("_g").alias("_f"))
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
        d = d.join(first, same).withColumn("_g", F.col("_g") - F.col("_f"))
    return d.select(*df.columns, (F.col("_g") + 1).alias(name))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, share, value): quantiles with linear interpolation, exact; from counts of the different values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    d = running_sums(counts, by, "_v", ["_c"])
    total = d.groupBy(*by).agg(F.max("_c_all").alias("_n"))
    at = total.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    at = at.select(*(F.col(b).alias(f"_q_{b}") for b in by), "share", "_at", F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi"))
    covers = lambda p: (F.col("_c_upto") > F.col(p)) & (F.col("_c_upto") - F.col("_c") <= F.col(p))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_q_{b}"))
    hit = d.join(F.broadcast(at), same & (covers("_lo") | covers("_hi")))  # as many rows as keys and shares
    got = hit.groupBy(*by, "share", "_at", "_lo").agg(F.max(F.when(covers("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(covers("_hi"), F.col("_v"))).alias("_b"))
    return got.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))).alias("value"))
