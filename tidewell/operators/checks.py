"""Data checks: each returns the offending rows, and is passed if there are none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import ratio


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    empty = F.lit(False)
    for c in columns:
        empty = empty | F.col(c).isNull()
    return df.where(empty)


def unique(df: DataFrame, *key: str | Column) -> DataFrame:
    """Keys that stand in more than one row, and in how many; nulls are equal."""
    return df.groupBy(*key).agg(F.count("*").alias("veces")).where("veces > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their rows; nulls pass."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("veces"))


def between(df: DataFrame, column: str, least: float | None = None, greatest: float | None = None) -> DataFrame:
    """Rows outside the inclusive range; nulls pass."""
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col(column) < least)
    if greatest is not None:
        bad = bad | (F.col(column) > greatest)
    return df.where(F.col(column).isNotNull() & bad)


def plausible_by_group(staged: DataFrame, hours: DataFrame, technologies: DataFrame) -> DataFrame:
    """Q4: values, raw or hourly, outside their technology's range, and those of series that nobody declared."""
    raw = staged.select(F.lit("raw").alias("modelo"), "indicador_id", F.col("instante").alias("momento"), F.col("potencia_mw").alias("valor"))
    hour = hours.select(F.lit("horaria").alias("modelo"), "indicador_id", F.col("hora").alias("momento"), F.col("potencia_media_mw").alias("valor"))
    bounds = technologies.select("indicador_id", "tecnologia", "min_mw", "max_mw")
    reason = F.when(F.col("tecnologia").isNull(), "sin declarar").when(F.col("valor") < F.col("min_mw"), "por debajo").when(F.col("valor") > F.col("max_mw"), "por encima")
    return raw.unionByName(hour).join(bounds, "indicador_id", "left").withColumn("motivo", reason).where("motivo IS NOT NULL")


def total_plausible(mart: DataFrame, least: float = 5_000.0, greatest: float = 60_000.0) -> DataFrame:
    """Q5: totals of covered hours outside the range."""
    return between(mart.where("cobertura_completa"), "potencia_total_mw", least, greatest)


def balance(generation: DataFrame, demand: DataFrame, least: float = 0.70, greatest: float = 1.60) -> DataFrame:
    """Q6, a warning: hours whose generation is out of proportion to demand."""
    joined = generation.join(demand, "hora").withColumn("razon", ratio(F.col("generacion_mw"), F.col("demanda_mw")))
    return joined.where(~F.col("razon").between(least, greatest)).select("hora", F.round("generacion_mw", 0).alias("generacion_mw"), F.round("demanda_mw", 0).alias("demanda_mw"), F.round("razon", 3).alias("razon"))


def freshness(df: DataFrame, column: str, as_of: Column, warn_hours: int = 6, error_hours: int = 24) -> DataFrame:
    """Q8: one row: the newest instant, its age and pass, warn or error. An empty table is an error."""
    row = df.agg(F.max(column).alias("ultimo")).withColumn("__now", as_of)
    age = F.expr("timestampdiff(SECOND, ultimo, __now)") / 3600.0
    state = F.when(F.col("ultimo").isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass")
    return row.select("ultimo", F.round(age, 4).alias("horas"), state.alias("estado"))


#: Column of a mart, least and greatest value.
MART_RANGES = {"generacion": (("razon_generacion_demanda", 0.5, 2.5), ("porcentaje_renovable", 0.0, 100.0)), "tecnologia": (("porcentaje_del_mix", -100.0, 100.0),)}


def mart_ranges(generation: DataFrame, technologies: DataFrame) -> DataFrame:
    """Q7: (mart, columna, hora, valor) of the marts' values beyond their ranges; nulls are none."""
    out = None
    for (name, ranges), mart in zip(MART_RANGES.items(), (generation, technologies), strict=True):
        for column, low, high in ranges:
            rows = between(mart, column, low, high).select(F.lit(name).alias("mart"), F.lit(column).alias("columna"), "hora", F.col(column).cast("double").alias("valor"))
            out = rows if out is None else out.unionByName(rows)
    return out
