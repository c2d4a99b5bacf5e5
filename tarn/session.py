"""Session settings and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Semantics that the engine relies on; performance settings stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class Tables:
    """Tables of a folder as attributes, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over the tables it names and over further frames by name; nothing is registered in the session."""
        named = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in text}
        return self._spark.sql(text, **named, **frames)
