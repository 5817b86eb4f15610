"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import saved

#: Bytes of a file of a table of links or labels, about.
FILE_BYTES = 4 << 20


def files_for(table: DataFrame) -> int:
    """Into how many files a table goes that is no larger than this saved one: small tables need not be many small files."""
    return max(1, -(-int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // FILE_BYTES))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node that links reach; nodes without links are absent.

    Each round hooks every node to its smallest neighbour, follows the hooks twice and contracts the links, so that
    the number of linked nodes at least halves. Hub nodes are only ever pre-aggregated or joined, never collected. Links
    only get fewer, so their size says how many files a round's tables need.
    """
    spark = links.sparkSession
    edges = saved(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u != v").distinct(), "edges")
    labels = saved(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("comp", F.col("node")).coalesce(files_for(edges)), "labels")
    while not edges.isEmpty():
        few = files_for(edges)
        both = edges.union(edges.select("v", "u"))
        hook = saved(both.groupBy(F.col("u").alias("label")).agg(F.min("v").alias("to")).select("label", F.least("label", "to").alias("to")).coalesce(few), "hook")
        for _ in range(2):
            on = hook.select(F.col("label").alias("to"), F.col("to").alias("further"))
            hook = hook.join(on, "to").select("label", F.col("further").alias("to"))
        hook = saved(hook.coalesce(few), "hook")
        labels = saved(labels.join(hook.withColumnRenamed("label", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).coalesce(files_for(labels)), "labels")
        for side in ("u", "v"):
            edges = edges.join(hook.select(F.col("label").alias(side), F.col("to").alias(f"{side}_to")), side).withColumn(side, F.col(f"{side}_to")).select("u", "v")
        edges = saved(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().coalesce(few), "edges")
    return labels
