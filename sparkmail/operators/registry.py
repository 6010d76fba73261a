"""Model registry.

The registry is a small Parquet table (one row per trained version). A new
version is written to a fresh folder and then becomes the current one;
overwriting the folder being read would fail in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail import schemas as S


def register(registry: DataFrame | None, new: DataFrame) -> DataFrame:
    """U1 + M5: new rows become champion, every existing row is demoted;
    columns missing on either side are allowed."""
    fresh = new.withColumn("is_champion", F.lit(True))
    if registry is None:
        return fresh
    old = registry.withColumn("is_champion", F.lit(False))
    return fresh.unionByName(old, allowMissingColumns=True)


def promote_if_better(registry: DataFrame, candidate: DataFrame, metric: str = "f1") -> DataFrame:
    """V5: the candidate becomes champion only if its ``metric`` beats the
    current champion's (no champion yet: it wins). The current best is a
    scalar subquery, so nothing is collected."""
    best = registry.where(F.col("is_champion")).agg(F.max(metric)).scalar()
    wins = F.coalesce(F.col(metric) > best, F.lit(True))
    cand = candidate.withColumn("_wins", wins)
    new_champ = cand.agg(F.max(F.col("_wins").cast("int"))).scalar() == 1
    old = registry.withColumn("is_champion", F.col("is_champion") & ~F.coalesce(new_champ, F.lit(False)))
    return cand.withColumn("is_champion", F.col("_wins")).drop("_wins").unionByName(old, allowMissingColumns=True)


def champion(registry: DataFrame) -> DataFrame:
    """M6: the champion row(s)."""
    return registry.where(F.col("is_champion"))


def history(registry: DataFrame) -> DataFrame:
    """M6: all versions, oldest first."""
    return registry.orderBy("created_at", "version")


def champion_by_latest(registry: DataFrame) -> DataFrame:
    """M5 in bulk: of many registered rows the newest (created_at, version)
    is the champion; the newest key is a scalar subquery."""
    key = F.struct("created_at", "version")
    newest = registry.agg(F.max(key)).scalar()
    return registry.withColumn("is_champion", F.coalesce(key == newest, F.lit(False)))


def write_registry(registry: DataFrame, root: str, generation: int) -> str:
    """Write a registry generation to its own folder (stage, then swap by
    pointing readers at the newest generation)."""
    path = f"{root.rstrip('/')}/model_registry/generation={generation}"
    registry.select(*[f.name for f in S.REGISTRY.fields]).write.mode("overwrite").parquet(path)
    return path


def read_registry(spark, root: str) -> DataFrame:
    """The newest generation of the registry."""
    from sparkmail.sources.lake import read_or_empty

    reg = read_or_empty(spark, f"{root.rstrip('/')}/model_registry", S.REGISTRY)
    if "generation" not in reg.columns:
        return reg
    newest = reg.agg(F.max(F.col("generation").cast("long"))).scalar()
    return reg.where(F.col("generation").cast("long") == newest).drop("generation")


def champion_path(registry: DataFrame):
    """The champion's model path (one row read on the driver; None if none)."""
    row = champion(registry).orderBy(F.col("created_at").desc()).select("model_path").first()
    return row["model_path"] if row else None


def load_champion(spark, root: str):
    """The champion model of the newest registry generation."""
    from pyspark.ml import PipelineModel

    path = champion_path(read_registry(spark, root))
    return PipelineModel.load(path) if path else None
