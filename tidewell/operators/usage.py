"""Who reads the tables: roll-up of query history, and verdicts on tables that no table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICE = ".gserviceaccount.com"  # fixed value: suffix of service accounts
READERS_SHOWN = 20


def reads(jobs: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Reads of each table by successful queries of the last days: counts, readers, people's queries, first and last, bytes.

    jobs: creation_time, user_email, job_type, state, error_result, total_bytes_billed, referenced_tables (array of project_id, dataset_id, table_id).
    A job that reads a table twice reads it once a mention, as the history has it.
    """
    recent = jobs.where((F.col("creation_time") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("job_type") == "QUERY") & (F.col("state") == "DONE") & F.col("error_result").isNull())
    rows = recent.select("creation_time", "user_email", "total_bytes_billed", F.explode("referenced_tables").alias("t"))
    table = F.lower(F.concat_ws(".", "t.project_id", "t.dataset_id", "t.table_id"))
    return rows.groupBy(table.alias("tabla")).agg(
        F.count("*").alias("consultas"),
        F.countDistinct("user_email").alias("lectores"),
        F.count_if(~F.col("user_email").endswith(SERVICE)).alias("consultas_de_personas"),
        F.slice(F.array_sort(F.collect_set("user_email")), 1, READERS_SHOWN).alias("quienes"),
        F.max("creation_time").alias("ultima_lectura"),
        F.min("creation_time").alias("primera_lectura"),
        F.coalesce(F.sum("total_bytes_billed"), F.lit(0)).alias("bytes_facturados"),
    )


def people(readers: Column) -> Column:
    """The readers that are no service accounts."""
    return F.filter(readers, lambda x: ~x.endswith(SERVICE))


def verdicts(orphans: DataFrame, usage: DataFrame | None) -> DataFrame:
    """(tabla, consultas, personas, veredicto, borrable), deletable first, then those that only the pipeline reads, then by name.

    Without a readable history (usage is None) nothing is deletable.
    """
    if usage is None:
        return orphans.select(F.col("id").alias("tabla"), F.lit(None).cast("long").alias("consultas"), F.array().cast("array<string>").alias("personas"), F.lit("historial no disponible").alias("veredicto"), F.lit(False).alias("borrable")).orderBy("tabla")
    joined = orphans.select(F.col("id").alias("tabla")).join(usage.select("tabla", "consultas", people(F.col("quienes")).alias("personas"), "consultas_de_personas"), "tabla", "left")
    read = F.coalesce("consultas", F.lit(0))
    by_people = F.coalesce(F.col("consultas_de_personas") > 0, F.lit(False))
    verdict = F.when(read == 0, "sin lecturas").when(by_people, "la usan personas").otherwise("solo la tuberia")
    rank = F.when(read == 0, 0).when(by_people, 2).otherwise(1)
    return joined.select("tabla", read.alias("consultas"), F.coalesce("personas", F.array().cast("array<string>")).alias("personas"), verdict.alias("veredicto"), (read == 0).alias("borrable"), rank.alias("__r")).orderBy("__r", "tabla").drop("__r")
