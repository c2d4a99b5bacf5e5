"""COPY: PostgreSQL's text and CSV formats, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Escapes of the text format (fixed values).
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def to_text(df: DataFrame, null: str = "\\N") -> DataFrame:
    """Rows in COPY text format, as column `value`."""

    def field(c: str) -> Column:
        s = F.col(f"`{c}`").cast("string")
        for raw, safe in ESCAPES:
            s = F.replace(s, F.lit(raw), F.lit(safe))
        return F.coalesce(s, F.lit(null))

    return df.select(F.concat_ws("\t", *[field(c) for c in df.columns]).alias("value"))


def from_text(lines: DataFrame, schema: StructType, null: str = "\\N") -> DataFrame:
    """Rows of COPY text format (column `value`) with the given schema."""
    parts = F.split("value", "\t")

    def field(i: int) -> Column:
        s = F.get(parts, F.lit(i))
        marked = F.replace(s, F.lit("\\\\"), F.lit("\0"))  # a doubled backslash must not join with what follows
        for raw, safe in ESCAPES[1:]:
            marked = F.replace(marked, F.lit(safe), F.lit(raw))
        return F.when(s != null, F.replace(marked, F.lit("\0"), F.lit("\\")))

    return lines.select(*[field(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def copy_to(df: DataFrame, path: str, form: str = "text", header: bool = False) -> None:
    """COPY … TO: a folder of part files."""
    if form == "csv":
        df.write.option("header", header).option("escape", '"').option("emptyValue", '""').csv(path)
    else:
        to_text(df).write.text(path)


def copy_from(spark: SparkSession, path: str, schema: StructType, form: str = "text", header: bool = False) -> DataFrame:
    """COPY … FROM with a stated schema."""
    if form == "csv":
        return spark.read.schema(schema).option("header", header).option("escape", '"').option("multiLine", True).csv(path)
    return from_text(spark.read.text(path), schema)


def write_partitioned(df: DataFrame, path: str, part: Column, name: str = "part") -> None:
    """Rows in a folder for each partition name, so that later reads skip folders by filter."""
    df.withColumn(name, part).repartition(F.col(name), F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(name).parquet(path)
