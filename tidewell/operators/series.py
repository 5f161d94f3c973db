"""Series of readings: latest versions, hourly roll-up, marts, audit, reconciliation.

Columns have the names of the published tables. Readings a point of a series may have many versions
of; every function takes and returns DataFrames and runs no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import percent, ratio, whole_units

POINT = ("indicador_id", "instante", "geo_id")
READINGS_PER_HOUR = 12


def latest(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row for each key (nulls are one key): the greatest by the columns of newest, in order. A sort and a rank limit."""
    order = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in newest])
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def latest_by_hash(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """latest() as one partial aggregation: versions meet before the shuffle, so hot keys send one row a task.

    Structs can't be updated in place, so both sides of the aggregation sort; what is saved is the rows that are sent.
    """
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*rest)
    order = F.struct(*newest)
    best = df.groupBy(*key).agg(F.max_by(row, order).alias("__row"))
    return best.select(*[F.col(c) if c in key else F.col("__row")[c].alias(c) for c in df.columns])


def staged_readings(raw: DataFrame) -> DataFrame:
    """The version in force of each point: last ingested, on ties the highest value."""
    best = latest_by_hash(raw, POINT, ("ingerido_en", "valor"))
    return best.select("indicador_id", "instante", F.col("valor").alias("potencia_mw"), "geo_id", "geo_nombre", "ingerido_en")


def staged_requests(audit: DataFrame) -> DataFrame:
    """Audit rows with outcome (null if the code is unknown), retries and whole hours asked for."""
    return audit.select(
        "momento", "indicador_id", "ventana_inicio", "ventana_fin", "codigo", "intentos", "puntos", "segundos", "error",
        F.expr("codigo = 200 AND error IS NULL").alias("exito"),
        (F.col("intentos") - 1).alias("reintentos"),
        whole_units("HOUR", "ventana_fin", "ventana_inicio").alias("horas_pedidas"),
    )


def hourly(staged: DataFrame, technologies: DataFrame, per_hour: int = READINGS_PER_HOUR) -> DataFrame:
    """Mean, least, greatest, energy, readings and completeness of each hour, series and zone.

    The technologies are one row for each series declared, a seed file; adaptive
    execution sends them to the tasks while they are small, and shuffles otherwise.
    """
    dims = technologies.select("indicador_id", "tecnologia", "familia", "renovable", "sumable", "orden_apilado")
    p = F.col("potencia_mw")
    sums = staged.groupBy(F.date_trunc("hour", "instante").alias("hora"), "indicador_id", "geo_id", "geo_nombre").agg(
        F.avg(p).alias("potencia_media_mw"),
        F.min(p).alias("potencia_min_mw"),
        F.max(p).alias("potencia_max_mw"),
        F.sum(p * (5.0 / 60.0)).alias("energia_mwh"),
        F.count("*").alias("lecturas"),
        (F.count("*") == per_hour).alias("hora_completa"),
        F.max("ingerido_en").alias("ingerido_en"),
    )
    # the series' attributes depend on its id, so they join after the aggregation has shrunk the rows
    return sums.join(dims, "indicador_id", "left").select(
        "hora", "indicador_id", "tecnologia", "familia", "renovable", "sumable", "orden_apilado", "geo_id", "geo_nombre",
        "potencia_media_mw", "potencia_min_mw", "potencia_max_mw", "energia_mwh", "lecturas", "hora_completa", "ingerido_en",
    )


def with_newest(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the greatest value of a column in every row: one aggregated row sent to all tasks, where a global window would take one task."""
    return df.crossJoin(F.broadcast(df.agg(F.max(column).alias(name))))


def recency(df: DataFrame, column: str = "hora") -> DataFrame:
    """df with whether a row is of the newest instant, and its age in whole hours relative to that."""
    out = with_newest(df, column, "__newest")
    return out.withColumn("es_ultima_hora", F.col(column) == F.col("__newest")).withColumn("horas_de_antiguedad", whole_units("HOUR", "__newest", column)).drop("__newest")


def generation_mart(hours: DataFrame, technologies: DataFrame, demand_id: int = 1293) -> DataFrame:
    """Total, renewable share and coverage of each complete hour and zone. The share is null unless all expected technologies are there."""
    expected = technologies.where("familia = 'generacion' AND sumable").agg(F.count("*").alias("tecnologias_esperadas"))
    p, green = F.col("potencia_media_mw"), F.col("renovable")
    totals = hours.where("hora_completa AND familia = 'generacion' AND sumable").groupBy("hora", "geo_id", "geo_nombre").agg(
        F.sum(p).alias("potencia_total_mw"),
        F.sum("energia_mwh").alias("energia_total_mwh"),
        F.sum(F.when(green, p).otherwise(0.0)).alias("potencia_renovable_mw"),
        F.sum(F.when(~green, p).otherwise(0.0)).alias("potencia_no_renovable_mw"),
        F.countDistinct("indicador_id").alias("tecnologias"),
        F.max("ingerido_en").alias("ingerido_en"),
    )
    demand = hours.where((F.col("indicador_id") == demand_id) & F.col("hora_completa")).select("hora", "geo_id", F.col("potencia_media_mw").alias("demanda_mw"))
    joined = recency(totals).crossJoin(F.broadcast(expected)).join(demand, ["hora", "geo_id"], "left")
    whole = F.col("tecnologias") == F.col("tecnologias_esperadas")
    return joined.select(
        "hora", "geo_id", "geo_nombre", "potencia_total_mw", "energia_total_mwh", "potencia_renovable_mw", "potencia_no_renovable_mw", "demanda_mw",
        F.round(ratio(F.col("potencia_total_mw"), F.col("demanda_mw")), 4).alias("razon_generacion_demanda"),
        "es_ultima_hora", "horas_de_antiguedad", "tecnologias", "tecnologias_esperadas",
        whole.alias("cobertura_completa"),
        F.when(whole, percent(F.col("potencia_renovable_mw"), F.col("potencia_total_mw"))).alias("porcentaje_renovable"),
        "ingerido_en",
    )


def technology_mart(hours: DataFrame, generation: DataFrame) -> DataFrame:
    """P5: each technology's share of an hour's mix; null if the hour is not covered."""
    total = generation.select("hora", "geo_id", F.col("potencia_total_mw").alias("__total"), F.col("cobertura_completa").alias("__whole"))
    own = recency(hours.where("hora_completa AND familia = 'generacion' AND sumable"))
    return own.join(total, ["hora", "geo_id"], "left").select(
        "hora", "geo_id", "geo_nombre", "indicador_id", "tecnologia", "renovable", "orden_apilado", "potencia_media_mw", "potencia_min_mw", "potencia_max_mw", "energia_mwh",
        F.when(F.col("__whole"), percent(F.col("potencia_media_mw"), F.col("__total"))).alias("porcentaje_del_mix"),
        "es_ultima_hora", "horas_de_antiguedad", "ingerido_en",
    )


def revisions(raw: DataFrame) -> DataFrame:
    """Points with more than one version, and points, of each day. A version that repeats the value counts too."""
    versions = raw.groupBy(*POINT).agg(F.count("*").alias("versiones"), F.countDistinct("valor").alias("valores"))
    return versions.groupBy(F.to_date("instante").alias("dia")).agg(
        F.count_if(F.col("versiones") > 1).alias("puntos_revisados"), F.count("*").alias("puntos_totales"), F.count_if(F.col("valores") > 1).alias("puntos_cambiados"))


def daily_requests(requests: DataFrame) -> DataFrame:
    """Outcomes of each day's requests; an unknown outcome is neither a success nor a failure."""
    return requests.groupBy(F.to_date("momento").alias("dia")).agg(
        F.count("*").alias("peticiones"), F.count_if("exito").alias("peticiones_ok"), F.count_if(~F.col("exito")).alias("peticiones_fallidas"),
        F.sum("intentos").alias("intentos_http"), F.sum("puntos").alias("puntos"), F.round(F.avg("segundos"), 3).alias("segundos_medios"))


def quality_mart(hours: DataFrame, raw: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Completeness, revisions, requests and freshness of each day; as_of stands for the time of the report."""
    days = hours.groupBy(F.to_date("hora").alias("dia")).agg(
        F.countDistinct("indicador_id").alias("indicadores"), F.count_if("hora_completa").alias("horas_completas"), F.count_if(~F.col("hora_completa")).alias("horas_parciales"),
        F.count("*").alias("__horas"), F.max("ingerido_en").alias("ultimo_dato"))
    joined = days.join(revisions(raw).drop("puntos_cambiados"), "dia", "left").join(daily_requests(requests).drop("puntos"), "dia", "left").withColumn("__now", as_of)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("puntos_revisados", "puntos_totales")]
    asked = [F.coalesce(c, F.lit(0)).alias(c) for c in ("peticiones", "peticiones_ok", "peticiones_fallidas", "intentos_http")]
    return joined.select(
        "dia", "indicadores", "horas_completas", "horas_parciales", percent(F.col("horas_completas"), F.col("__horas")).alias("porcentaje_horas_completas"),
        *zero, percent(F.coalesce("puntos_revisados", F.lit(0)), F.coalesce("puntos_totales", F.lit(0))).alias("porcentaje_revisado"),
        *asked, "segundos_medios", "ultimo_dato", whole_units("MINUTE", "__now", "ultimo_dato").alias("minutos_desde_el_ultimo_dato"))


def current_panes(panes: DataFrame) -> DataFrame:
    """The last pane emitted of each hour and series; on ties of time the highest pane."""
    return latest_by_hash(panes, ("hora", "indicador_id"), ("emitido_en", "panel"))


def reconcile(batch: DataFrame, stream: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """One row: hours in both, means apart by more than tolerance, counts that differ, greatest difference."""
    b = batch.where("hora_completa").select("hora", "indicador_id", F.col("potencia_media_mw").alias("b"), F.col("lecturas").alias("nb"))
    s = stream.where("hora_completa").select("hora", "indicador_id", F.col("potencia_media_mw").alias("s"), F.col("lecturas").alias("ns"))
    apart = F.abs(F.col("b") - F.col("s"))
    return b.join(s, ["hora", "indicador_id"]).agg(F.count("*").alias("horas"), F.count_if(apart > tolerance).alias("medias_mal"), F.count_if(F.col("nb") != F.col("ns")).alias("conteos_mal"), F.max(apart).alias("peor"))


def by_zone(readings: DataFrame, value: str = "valor") -> DataFrame:
    """Count, least, greatest and mean of each zone."""
    v = F.col(value)
    return readings.groupBy("geo_id").agg(F.count("*").alias("puntos"), F.min(v).alias("minimo"), F.max(v).alias("maximo"), F.avg(v).alias("media"))


def sum_or_mean(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """For each coarse value (indicador_id, hora, valor) whether it is the sum or the mean of the hour's fine readings."""
    hour = fine.groupBy("indicador_id", F.date_trunc("hour", "instante").alias("hora")).agg(F.sum("valor").alias("suma"), F.avg("valor").alias("media"))
    far = lambda c: F.abs(F.col("valor") - F.col(c))
    return coarse.join(hour, ["indicador_id", "hora"]).select("indicador_id", "hora", "valor", "suma", "media", F.when(far("suma") < far("media"), "SUM").otherwise("AVG").alias("veredicto"))


def outcomes(requests: DataFrame) -> DataFrame:
    """One row: requests, those with an HTTP answer of success, those without, points and attempts; cuadra says that the first is the sum of the next two."""
    ok = F.coalesce("exito", F.lit(False))
    sums = requests.agg(F.count("*").alias("peticiones"), F.count_if(ok).alias("peticiones_ok"), F.count_if(~ok).alias("peticiones_fallidas"), F.sum("puntos").alias("puntos"), F.sum("intentos").alias("intentos_http"))
    return sums.withColumn("cuadra", F.col("peticiones_ok") + F.col("peticiones_fallidas") == F.col("peticiones"))


def on_page(mart: DataFrame, last_hours: int | None = None) -> DataFrame:
    """The dashboard's rows: hours that are covered (where the mart says so), and of these the newest hour or the last so many."""
    covered = mart.where("cobertura_completa") if "cobertura_completa" in mart.columns else mart
    return covered.where("es_ultima_hora") if last_hours is None else covered.where(F.col("horas_de_antiguedad") < last_hours)


def cards(mart: DataFrame, quality: DataFrame, last_hours: int | None = None) -> DataFrame:
    """One row: mean generation, renewable share and demand of the page's hours, greatest age of the data, and its colour."""
    age = F.col("antiguedad_min")
    now = on_page(mart, last_hours).agg(F.avg("potencia_total_mw").alias("generacion_mw"), F.avg("porcentaje_renovable").alias("porcentaje_renovable"), F.avg("demanda_mw").alias("demanda_mw"))
    old = quality.agg(F.max("minutos_desde_el_ultimo_dato").alias("antiguedad_min"))
    colour = F.when(age < 15, "verde").when(age < 90, "ambar").when(age >= 90, "rojo")  # fixed values: the page's limits in minutes
    return now.crossJoin(F.broadcast(old)).withColumn("color", colour)


def by_renewable(technologies: DataFrame) -> DataFrame:
    """Energy and mean power of technologies that generate, by whether they are renewable."""
    return technologies.where("potencia_media_mw > 0").groupBy("renovable").agg(F.sum("energia_mwh").alias("energia_mwh"), F.avg("potencia_media_mw").alias("potencia_media_mw"), F.max("potencia_max_mw").alias("potencia_max_mw"))


def hour_profile(hours: DataFrame) -> DataFrame:
    """Mean power of each hour of the day."""
    return hours.groupBy(F.hour("hora").alias("hora_del_dia")).agg(F.avg("potencia_media_mw").alias("potencia_media_mw"), F.count("*").alias("horas"))


def energy_ranking(hours: DataFrame, n: int = 11) -> DataFrame:
    """The n technologies with the most energy, in stacking order on ties."""
    return hours.groupBy("tecnologia", "orden_apilado").agg(F.sum("energia_mwh").alias("energia_mwh")).orderBy(F.desc("energia_mwh"), "orden_apilado", "tecnologia").limit(n)
