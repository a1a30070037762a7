"""Writers: snapshots, upserts and replacements over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.market import latest_rows


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by kind and edges by relation, places kept (SNK-01)."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_artifacts(rows: DataFrame, path: str, key: str, by: str) -> None:
    """One row for each id; only the partitions that the rows touch are rewritten (SNK-02)."""
    rows.dropDuplicates([key]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, the new ones winning (SNK-03)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return latest_rows(both, keys, ["_batch"]).drop("_batch")


def replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Old rows of other parents, and the new rows (SNK-04)."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def append(rows: DataFrame, path: str) -> None:
    """An append-only log (SNK-05)."""
    rows.write.mode("append").parquet(path)
