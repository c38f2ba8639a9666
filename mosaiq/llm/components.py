"""Connected components of links between integer ids, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, class_id): the least id that each linked id reaches. Each round is written to the shared folder.

    Alternating star rounds keep at most as many edges as came in, and halve the depth of the trees, so that no
    component is ever gathered in one task or on the driver.
    """
    both = lambda e: e.select(F.col("u"), F.col("v")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        least = both(e).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both(e).join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # larger neighbours to the least
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = materialize(small, "edges")
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() or e.join(new, ["u", "v"], "left_anti").limit(1).count()
        discard(e)
        e = new
        if not changed:
            break
    return e.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "id").unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
