"""Set-returning functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """Whole numbers as a distributed range, of any length."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).toDF(name)


def date_series(spark: SparkSession, start: str, stop: str, step: str, name: str = "generate_series", kind: str = "timestamp_ntz") -> DataFrame:
    """generate_series(start, stop, interval) over timestamps or dates: whole months are added to the start, other steps are spread as a range of their number."""
    count, unit = step.split()
    months = {"month": 1, "year": 12}.get(unit.rstrip("s"))
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, stop))
    if months:
        n = F.months_between(last.cast("timestamp"), first.cast("timestamp"))
        ends = spark.range(1).select(F.floor(n / (int(count) * months)).alias("n")).first()["n"]
        at = F.make_ym_interval(F.lit(0), (F.col("id") * int(count) * months).cast("int"))
        return spark.range(0, max(0, ends + 1)).select((first + at).cast(kind).alias(name))
    micros = {"microsecond": 1, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}[unit.rstrip("s")] * int(count)
    a, b = spark.range(1).select(F.unix_micros(first.cast("timestamp")).alias("a"), F.unix_micros(last.cast("timestamp")).alias("b")).first()
    return spark.range(a, b + (1 if micros > 0 else -1), micros).select(F.timestamp_micros("id").cast("timestamp_ntz").cast(kind).alias(name))


def series(start: Column, stop: Column, step: Column | int = 1) -> Column:
    """generate_series(start, stop, step) in a LATERAL: rows only if the step leads from start to stop."""
    step = step if isinstance(step, Column) else F.lit(step)
    return F.explode(F.when((step > 0) == (stop >= start), F.sequence(start, stop, step)).when(start == stop, F.array(start)))


def unnest(df: DataFrame, **arrays: Column) -> DataFrame:
    """FROM df, unnest(a, b, …) AS (names): arrays side by side, shorter ones padded with null."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    out = df.select("*", F.explode(zipped).alias("__z__"))
    return out.select(*df.columns, *[F.col("__z__").getField(str(i)).alias(n) if n not in out.schema["__z__"].dataType.names else F.col(f"__z__.`{n}`").alias(n) for i, n in enumerate(arrays)])


def with_ordinality(df: DataFrame, array: Column, value: str, ordinality: str = "ordinality", outer: bool = False) -> DataFrame:
    """FROM df [LEFT] JOIN LATERAL unnest(array) WITH ORDINALITY, counted from 1."""
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select("*", explode(array).alias("__p__", value)).withColumn(ordinality, (F.col("__p__") + 1).cast("long")).drop("__p__")


def generate_subscripts(array: Column) -> Column:
    return F.explode(F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array))))


def string_to_table(text: Column, delimiter: str) -> Column:
    return F.explode(F.split(text, F.lit("\\Q" + delimiter + "\\E")))


def regexp_split_to_table(text: Column, pattern: str) -> Column:
    return F.explode(F.split(text, pattern))


def json_each(df: DataFrame, json: Column, key: str = "key", value: str = "value") -> DataFrame:
    """json_each_text: a row for each member of a JSON object."""
    return df.select("*", F.explode(F.from_json(json, "map<string,string>")).alias(key, value))


def json_table(df: DataFrame, json: Column, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """JSON_TABLE over one object: columns name -> (path, type)."""
    return df.select("*", *[F.get_json_object(json, path).cast(kind).alias(name) for name, (path, kind) in columns.items()])


def tablesample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE BERNOULLI (percent) [REPEATABLE (seed)]."""
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)
