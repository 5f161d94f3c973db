"""Registered queries over the driver's tables: name, Spark form and DuckDB form side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import scalars
from tidewell.operators import ask, checks, lineage, planner, register, series, sqlrefs, usage
from tidewell.sources import api, metadata, store
from tidewell.streaming import gates

from . import fixtures as x

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def plainly(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(f(spark, sf_dir))

        QUERIES[f.__name__] = plainly
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def plain_types(df: DataFrame) -> DataFrame:
    """Instants without a zone, as the oracle has them, and doubles to four digits, as their sums depend on the order."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 4)
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded_like_oracle(c: str) -> Column:
    """A double to four digits as DuckDB rounds it: the product with 10^4, not the decimal digits, decides on which side of a tie it is."""
    scaled = F.abs(F.col(c)) * 1e4
    whole = F.floor(scaled).cast("double")
    near = whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(scaled < 2.0**52, F.signum(c) * near / 1e4).otherwise(F.col(c))  # beyond, doubles have no digits to round


def rounded(select: str, doubles: str) -> str:
    """The oracle's rows with the named doubles to four digits."""
    return f"SELECT * REPLACE ({', '.join(f'round({d}, 4) AS {d}' for d in doubles.split())}) FROM ({select})"


_LINE_KEY = ("l_orderkey", "l_linenumber")
_LINE_NEWEST = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_DEDUPE = f"SELECT * REPLACE (round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax) FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINE_NEWEST)}) = 1"
_HOURLY = "potencia_media_mw potencia_min_mw potencia_max_mw energia_mwh"
_MART = "potencia_total_mw energia_total_mwh potencia_renovable_mw potencia_no_renovable_mw demanda_mw razon_generacion_demanda porcentaje_renovable"


@query(_DEDUPE)
def dedupe_latest(spark, sf):
    return series.latest(x.table(spark, sf, "lineitem"), _LINE_KEY, _LINE_NEWEST)


@query(_DEDUPE)
def dedupe_latest_by_hash(spark, sf):
    return series.latest_by_hash(x.table(spark, sf, "lineitem"), _LINE_KEY, _LINE_NEWEST)


def _staged(spark, sf):
    return series.staged_readings(x.readings(spark, sf))


def _hours(spark, sf):
    return series.hourly(_staged(spark, sf), x.technologies(spark), x.PER_HOUR)


def _mart(spark, sf):
    return series.generation_mart(_hours(spark, sf), x.technologies(spark), x.DEMAND_ID)


@query(f"WITH {x.STAGED_SQL} SELECT indicador_id, instante, round(potencia_mw, 4) AS potencia_mw, geo_id, geo_nombre, ingerido_en FROM stg")
def staged_readings(spark, sf):
    return _staged(spark, sf)


@query(f"WITH {x.HOURLY_SQL} " + rounded("SELECT * FROM hor", _HOURLY))
def hourly_rollup(spark, sf):
    return _hours(spark, sf)


@query(f"WITH {x.MART_SQL} " + rounded("SELECT * FROM mart", _MART))
def flagship_mart(spark, sf):
    return _mart(spark, sf)


@query(f"""WITH {x.MART_SQL},
own AS (SELECT *, hora = max(hora) OVER () AS es_ultima_hora, date_sub('hour', hora, max(hora) OVER ()) AS horas_de_antiguedad FROM hor WHERE hora_completa AND familia = 'generacion' AND sumable)
SELECT own.hora, own.geo_id, own.geo_nombre, indicador_id, tecnologia, renovable, orden_apilado, round(potencia_media_mw, 4) AS potencia_media_mw, round(potencia_min_mw, 4) AS potencia_min_mw,
  round(potencia_max_mw, 4) AS potencia_max_mw, round(energia_mwh, 4) AS energia_mwh,
  CASE WHEN cobertura_completa THEN round(100.0 * potencia_media_mw / nullif(potencia_total_mw, 0), 2) END AS porcentaje_del_mix,
  own.es_ultima_hora, own.horas_de_antiguedad, own.ingerido_en
FROM own LEFT JOIN mart ON own.hora = mart.hora AND own.geo_id = mart.geo_id""")
def share_of_total(spark, sf):
    return series.technology_mart(_hours(spark, sf), _mart(spark, sf))


@query(f"""WITH {x.HOURLY_SQL}, {x.REQUESTS_SQL},
d AS (SELECT hora::DATE AS dia, count(DISTINCT indicador_id) AS indicadores, count(*) FILTER (hora_completa) AS horas_completas, count(*) FILTER (NOT hora_completa) AS horas_parciales, count(*) AS n, max(ingerido_en) AS ultimo_dato FROM hor GROUP BY ALL),
v AS (SELECT instante::DATE AS dia, count(*) FILTER (c > 1) AS puntos_revisados, count(*) AS puntos_totales FROM (SELECT indicador_id, instante, geo_id, count(*) AS c FROM raw GROUP BY ALL) GROUP BY ALL),
p AS (SELECT momento::DATE + 8700 AS dia, count(*) AS peticiones, count(*) FILTER (exito) AS peticiones_ok, count(*) FILTER (NOT exito) AS peticiones_fallidas, sum(intentos)::BIGINT AS intentos_http, round(avg(segundos), 3) AS segundos_medios FROM req GROUP BY ALL)
SELECT dia, indicadores, horas_completas, horas_parciales, round(100.0 * horas_completas / nullif(n, 0), 2) AS porcentaje_horas_completas, coalesce(puntos_revisados, 0) AS puntos_revisados, coalesce(puntos_totales, 0) AS puntos_totales,
  round(100.0 * coalesce(puntos_revisados, 0) / nullif(coalesce(puntos_totales, 0), 0), 2) AS porcentaje_revisado, coalesce(peticiones, 0) AS peticiones, coalesce(peticiones_ok, 0) AS peticiones_ok,
  coalesce(peticiones_fallidas, 0) AS peticiones_fallidas, coalesce(intentos_http, 0) AS intentos_http, segundos_medios, ultimo_dato, date_sub('minute', ultimo_dato, TIMESTAMP '{x.AS_OF}') AS minutos_desde_el_ultimo_dato
FROM d LEFT JOIN v USING (dia) LEFT JOIN p USING (dia)""")
def daily_quality(spark, sf):
    shifted = series.staged_requests(x.requests(spark, sf)).withColumn("momento", F.col("momento") + F.expr("INTERVAL 8700 DAYS"))
    return series.quality_mart(_hours(spark, sf), x.readings(spark, sf), shifted, F.lit(x.AS_OF).cast("timestamp"))


@query(f"WITH {x.REQUESTS_SQL} SELECT * REPLACE (round(segundos, 4) AS segundos) FROM req")
def audit_outcomes(spark, sf):
    return series.staged_requests(x.requests(spark, sf))


@query(f"WITH {x.REQUESTS_SQL} SELECT momento::DATE AS dia, count(*) AS peticiones, count(*) FILTER (exito) AS peticiones_ok, count(*) FILTER (NOT exito) AS peticiones_fallidas, sum(intentos)::BIGINT AS intentos_http, sum(puntos)::BIGINT AS puntos, round(avg(segundos), 3) AS segundos_medios FROM req GROUP BY ALL")
def audit_daily(spark, sf):
    return series.daily_requests(series.staged_requests(x.requests(spark, sf)))


@query(f"WITH {x.READINGS_SQL} SELECT instante::DATE AS dia, count(*) FILTER (c > 1) AS puntos_revisados, count(*) AS puntos_totales, count(*) FILTER (v > 1) AS puntos_cambiados FROM (SELECT indicador_id, instante, geo_id, count(*) AS c, count(DISTINCT valor) AS v FROM raw GROUP BY ALL) GROUP BY ALL")
def revisions(spark, sf):
    return series.revisions(x.readings(spark, sf))


def _panes(spark, sf):
    e = x.table(spark, sf, "events")
    return e.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hora"), F.col("user_id").alias("indicador_id"), "value", F.col("event_id").alias("panel"), F.col("ts").cast("timestamp").alias("emitido_en"))


@query("SELECT date_trunc('hour', ts) AS hora, user_id AS indicador_id, round(value, 4) AS value, event_id AS panel, ts AS emitido_en FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_pane(spark, sf):
    return series.current_panes(_panes(spark, sf))


@query(f"""WITH {x.HOURLY_SQL},
alt AS (SELECT date_trunc('hour', instante) AS hora, indicador_id, sum(potencia_mw) / count(*) + any_value(CASE WHEN indicador_id = 2 THEN 0.01 ELSE 0 END) AS m, count(*) AS n FROM stg WHERE geo_id = 1 GROUP BY 1, 2 HAVING count(*) = {x.PER_HOUR})
SELECT count(*) AS horas, count(*) FILTER (abs(potencia_media_mw - m) > 0.001) AS medias_mal, count(*) FILTER (lecturas <> n) AS conteos_mal, round(max(abs(potencia_media_mw - m)), 4) AS peor
FROM hor JOIN alt USING (hora, indicador_id) WHERE geo_id = 1 AND hora_completa""")
def reconcile(spark, sf):
    staged = _staged(spark, sf).where("geo_id = 1")
    shift = F.when(F.col("indicador_id") == 2, 0.01).otherwise(0.0)
    other = staged.groupBy(F.date_trunc("hour", "instante").alias("hora"), "indicador_id").agg((F.sum("potencia_mw") / F.count("*")).alias("m"), F.count("*").alias("lecturas"))
    other = other.select("hora", "indicador_id", (F.col("m") + shift).alias("potencia_media_mw"), "lecturas", (F.col("lecturas") == x.PER_HOUR).alias("hora_completa"))
    return series.reconcile(_hours(spark, sf).where("geo_id = 1"), other)


@query("SELECT event_id, ts AS hora, ts = max(ts) OVER () AS es_ultima_hora, date_sub('hour', ts, max(ts) OVER ()) AS horas_de_antiguedad FROM events")
def global_recency(spark, sf):
    return series.recency(x.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("hora")))


@query(f"WITH {x.READINGS_SQL} SELECT geo_id, count(*) AS puntos, round(min(valor), 4) AS minimo, round(max(valor), 4) AS maximo, round(avg(valor), 4) AS media FROM raw GROUP BY geo_id")
def zone_diagnosis(spark, sf):
    return series.by_zone(x.readings(spark, sf))


@query(f"""WITH {x.READINGS_SQL}, h AS (SELECT indicador_id, date_trunc('hour', instante) AS hora, sum(valor) AS suma, avg(valor) AS media FROM raw GROUP BY ALL),
c AS (SELECT indicador_id, hora, CASE WHEN indicador_id % 2 = 0 THEN suma + 0.25 ELSE media + 0.25 END AS valor FROM h)
SELECT indicador_id, hora, round(valor, 4) AS valor, round(suma, 4) AS suma, round(media, 4) AS media, CASE WHEN round(abs(valor - suma), 6) < round(abs(valor - media), 6) THEN 'SUM' ELSE 'AVG' END AS veredicto FROM c JOIN h USING (indicador_id, hora) WHERE abs(suma - media) > 1""")
def granularity_verdict(spark, sf):
    raw = x.readings(spark, sf)
    h = raw.groupBy("indicador_id", F.date_trunc("hour", "instante").alias("hora")).agg(F.sum("valor").alias("s"), F.avg("valor").alias("m"))
    coarse = h.select("indicador_id", "hora", F.when(F.col("indicador_id") % 2 == 0, F.col("s") + 0.25).otherwise(F.col("m") + 0.25).alias("valor"))
    return series.sum_or_mean(raw, coarse).where("abs(suma - media) > 1")


@query(f"WITH {x.HOURLY_SQL} SELECT extract(hour FROM hora)::INT AS hora_del_dia, round(avg(potencia_media_mw), 4) AS potencia_media_mw, count(*) AS horas FROM hor GROUP BY ALL")
def hour_of_day_profile(spark, sf):
    return series.hour_profile(_hours(spark, sf))


@query(f"WITH {x.HOURLY_SQL} SELECT tecnologia, orden_apilado, round(sum(energia_mwh), 4) AS energia_mwh FROM hor GROUP BY ALL ORDER BY 3 DESC LIMIT 3")
def ranking_energy(spark, sf):
    return series.energy_ranking(_hours(spark, sf), 3)


@query(f"WITH {x.REQUESTS_SQL} SELECT count(*) AS peticiones, count(*) FILTER (exito) AS peticiones_ok, count(*) FILTER (exito IS NOT TRUE) AS peticiones_fallidas, sum(puntos)::BIGINT AS puntos, sum(intentos)::BIGINT AS intentos_http, TRUE AS cuadra FROM req")
def request_outcomes(spark, sf):
    return series.outcomes(series.staged_requests(x.requests(spark, sf)))


_AGE_SQL = f"d AS (SELECT hora::DATE AS dia, date_sub('minute', max(ingerido_en), TIMESTAMP '{x.AS_OF}') AS m FROM hor GROUP BY ALL), edad AS (SELECT max(m) AS m FROM d)"


@query(f"""WITH {x.MART_SQL}, {_AGE_SQL}
SELECT round(avg(potencia_total_mw), 4) AS generacion_mw, round(avg(porcentaje_renovable), 4) AS porcentaje_renovable, round(avg(demanda_mw), 4) AS demanda_mw, (SELECT m FROM edad) AS antiguedad_min,
       (SELECT CASE WHEN m < 15 THEN 'verde' WHEN m < 90 THEN 'ambar' WHEN m >= 90 THEN 'rojo' END FROM edad) AS color
FROM mart WHERE cobertura_completa AND horas_de_antiguedad < 480""")
def dashboard_cards(spark, sf):
    quality = series.quality_mart(_hours(spark, sf), x.readings(spark, sf), series.staged_requests(x.requests(spark, sf)), F.lit(x.AS_OF).cast("timestamp"))
    return series.cards(_mart(spark, sf), quality, 480)


@query(f"WITH {x.HOURLY_SQL} SELECT renovable, round(sum(energia_mwh), 4) AS energia_mwh, round(avg(potencia_media_mw), 4) AS potencia_media_mw, round(max(potencia_max_mw), 4) AS potencia_max_mw FROM hor WHERE hora_completa AND familia = 'generacion' AND sumable AND potencia_media_mw > 0 GROUP BY renovable")
def dashboard_by_renewable(spark, sf):
    return series.by_renewable(series.technology_mart(_hours(spark, sf), _mart(spark, sf)))


# data checks


@query(f"""WITH {x.HOURLY_SQL}, u AS (SELECT 'raw' AS modelo, indicador_id, instante AS momento, potencia_mw AS valor FROM stg UNION ALL SELECT 'horaria', indicador_id, hora, potencia_media_mw FROM hor),
m AS (SELECT u.*, tecnologia, min_mw, max_mw, CASE WHEN tecnologia IS NULL THEN 'sin declarar' WHEN valor < min_mw THEN 'por debajo' WHEN valor > max_mw THEN 'por encima' END AS motivo FROM u LEFT JOIN (SELECT * FROM tec WHERE indicador_id <> 4) USING (indicador_id))
SELECT indicador_id, modelo, momento, round(valor, 4) AS valor, tecnologia, min_mw, max_mw, motivo FROM m WHERE motivo IS NOT NULL""")
def range_violations(spark, sf):
    return checks.plausible_by_group(_staged(spark, sf), _hours(spark, sf), x.technologies(spark).where("indicador_id <> 4"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS veces FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def composite_key_dups(spark, sf):
    return checks.unique(x.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.08")
def between_check(spark, sf):
    return checks.between(x.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "l_discount", 0.02, 0.08)


@query(f"WITH {x.READINGS_SQL} SELECT indicador_id, instante, ingerido_en FROM raw WHERE geo_id IS NULL OR geo_nombre IS NULL")
def not_null_check(spark, sf):
    return checks.not_null(x.readings(spark, sf), "geo_id", "geo_nombre").select("indicador_id", "instante", "ingerido_en")


@query("SELECT o_orderstatus, count(*) AS veces FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL")
def accepted_values(spark, sf):
    return checks.accepted_values(x.table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])


@query("SELECT max(ts) AS ultimo, round(date_sub('second', max(ts), TIMESTAMP '2024-01-31 06:30:00') / 3600.0, 4)::DOUBLE AS horas, CASE WHEN date_sub('second', max(ts), TIMESTAMP '2024-01-31 06:30:00') / 3600.0 > 24 THEN 'error' WHEN date_sub('second', max(ts), TIMESTAMP '2024-01-31 06:30:00') / 3600.0 > 6 THEN 'warn' ELSE 'pass' END AS estado FROM events")
def freshness(spark, sf):
    return checks.freshness(x.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts", F.lit("2024-01-31 06:30:00").cast("timestamp"))


@query(f"WITH {x.MART_SQL} " + rounded("SELECT * FROM mart WHERE cobertura_completa AND (potencia_total_mw < 50 OR potencia_total_mw > 150)", _MART))
def total_plausible(spark, sf):
    return checks.total_plausible(_mart(spark, sf), 50.0, 150.0)


@query(f"""WITH {x.HOURLY_SQL}, g AS (SELECT hora, sum(potencia_media_mw) AS generacion_mw FROM hor WHERE familia = 'generacion' GROUP BY ALL), d AS (SELECT hora, sum(potencia_media_mw) AS demanda_mw FROM hor WHERE familia = 'demanda' GROUP BY ALL)
SELECT hora, round(generacion_mw, 0) AS generacion_mw, round(demanda_mw, 0) AS demanda_mw, round(generacion_mw / nullif(demanda_mw, 0), 3) AS razon FROM g JOIN d USING (hora) WHERE NOT generacion_mw / nullif(demanda_mw, 0) BETWEEN 0.7 AND 1.6""")
def generation_balance(spark, sf):
    hours = _hours(spark, sf)
    total = lambda family, name: hours.where(F.col("familia") == family).groupBy("hora").agg(F.sum("potencia_media_mw").alias(name))
    return checks.balance(total("generacion", "generacion_mw"), total("demanda", "demanda_mw"))


@query(f"""WITH {x.MART_SQL}, own AS (SELECT hor.hora, CASE WHEN cobertura_completa THEN round(100.0 * potencia_media_mw / nullif(potencia_total_mw, 0), 2) END AS mix
  FROM hor LEFT JOIN mart ON hor.hora = mart.hora AND hor.geo_id = mart.geo_id WHERE hora_completa AND familia = 'generacion' AND sumable)
SELECT 'generacion' AS mart, 'razon_generacion_demanda' AS columna, hora, razon_generacion_demanda::DOUBLE AS valor FROM mart WHERE razon_generacion_demanda NOT BETWEEN 0.5 AND 2.5
UNION ALL SELECT 'generacion', 'porcentaje_renovable', hora, porcentaje_renovable::DOUBLE FROM mart WHERE porcentaje_renovable NOT BETWEEN 0 AND 100
UNION ALL SELECT 'tecnologia', 'porcentaje_del_mix', hora, mix::DOUBLE FROM own WHERE mix NOT BETWEEN -100 AND 100""")
def mart_ranges(spark, sf):
    return checks.mart_ranges(_mart(spark, sf), series.technology_mart(_hours(spark, sf), _mart(spark, sf)))


# lineage


def _graph(spark):
    return lineage.Graph.of([x.node_frame(spark, x.NODES_A), x.node_frame(spark, x.NODES_B)], [x.edge_frame(spark, x.EDGES_A), x.edge_frame(spark, x.EDGES_B)])


def _cyclic(spark):
    return lineage.merged_edges(x.edge_frame(spark, x.CYCLIC))


_GRAPH = f"WITH RECURSIVE {x.EDGES_SQL}, {x.NODES_SQL}"


def _reach_sql(start: str, here: str, there: str, hops: int = 99, edges: str = "edges") -> str:
    return f"""r AS (SELECT '{start}' AS id, 0 AS salto, ['{start}'] AS path UNION ALL
  SELECT {there}, salto + 1, list_append(path, {there}) FROM r JOIN {edges} ON r.id = {edges}.{here} WHERE NOT list_contains(path, {there}) AND salto < {hops}),
f AS (SELECT id, salto, min(path) AS path FROM r WHERE salto = (SELECT min(salto) FROM r q WHERE q.id = r.id) GROUP BY ALL)
SELECT id, salto, path[-2] AS via FROM f WHERE salto > 0"""


@query(f"WITH {x.EDGES_SQL} SELECT * FROM edges")
def edge_merge(spark, sf):
    return lineage.merged_edges(x.edge_frame(spark, x.EDGES_A), x.edge_frame(spark, x.EDGES_B))


@query(f"WITH {x.EDGES_SQL}, {x.NODES_SQL} SELECT * FROM nodes")
def node_merge(spark, sf):
    return _graph(spark).nodes


@query(f"{_GRAPH}, {_reach_sql('w.raw.orders', 'origen', 'destino')}")
def reach_forward(spark, sf):
    return _graph(spark).impact("w.raw.orders")


@query(f"{_GRAPH}, {_reach_sql('w.mart.quality', 'destino', 'origen')}")
def reach_backward(spark, sf):
    return _graph(spark).ancestry("w.mart.quality")


@query(f"{_GRAPH}, {_reach_sql('w.raw.orders', 'origen', 'destino', 2)}")
def reach_two_hops(spark, sf):
    return _graph(spark).impact("w.raw.orders", 2)


@query(f"WITH RECURSIVE c AS (SELECT DISTINCT origen, destino FROM (VALUES {x.values(x.CYCLIC)}) t(origen, destino, m) WHERE origen <> destino), {_reach_sql('a', 'origen', 'destino', edges='c')}")
def reach_cyclic(spark, sf):
    return lineage.reach(_cyclic(spark).select(F.col("origen").alias("a"), F.col("destino").alias("b")), "a")


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT origen, destino FROM (VALUES {x.values(x.CYCLIC)}) t(origen, destino, m) WHERE origen <> destino),
t AS (SELECT origen AS a, destino AS b FROM c UNION SELECT a, destino FROM t JOIN c ON b = origen)
SELECT p.a AS id, min(p.b) AS componente FROM t p JOIN t q ON p.a = q.b AND p.b = q.a GROUP BY p.a""")
def cycle_members(spark, sf):
    return lineage.strongly_connected(_cyclic(spark))


@query(f"SELECT * FROM (VALUES {x.values([('a', 'a > b > a'), ('g', 'g > h > g')])}) t(id, camino)")
def cycle_paths(spark, sf):
    edges = sorted((a, b) for a, b, _ in x.CYCLIC if a != b)
    paths = lineage.back_edge_paths(sorted({n for e in edges for n in e}), edges)
    return spark.createDataFrame([(p[0], " > ".join(p)) for p in paths], "id string, camino string")


@query(f"WITH {x.EDGES_SQL}, {x.NODES_SQL} SELECT id FROM nodes WHERE tipo <> 'externo' AND id NOT IN (SELECT origen FROM edges)")
def orphans(spark, sf):
    return _graph(spark).orphans()


@query(f"WITH {x.EDGES_SQL}, {x.NODES_SQL} SELECT id FROM nodes WHERE tipo <> 'externo' AND id NOT IN (SELECT destino FROM edges)")
def roots(spark, sf):
    return _graph(spark).roots()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_orphans(spark, sf):
    returned = x.table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return x.table(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


# A graph of the driver's tables: regions, nations, customers, orders. With small=0 the questions take the joins.

_TABLE_EDGES_SQL = """e AS (
  SELECT DISTINCT 'r' || n_regionkey AS origen, 'n' || n_nationkey AS destino FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_RING_SQL = "e AS (SELECT DISTINCT 'k' || (c_custkey % 60) AS origen, 'k' || ((c_custkey % 60) * 2 + 1) % 60 AS destino FROM customer)"


def _table_edges(spark, sf):
    pair = lambda t, a, x0, b, y0: x.table(spark, sf, t).select(F.concat(F.lit(x0), a).alias("origen"), F.concat(F.lit(y0), b).alias("destino"))
    return pair("nation", "n_regionkey", "r", "n_nationkey", "n").union(pair("customer", "c_nationkey", "n", "c_custkey", "c")).union(pair("orders", "o_custkey", "c", "o_orderkey", "o"))


@query(f"""WITH {_TABLE_EDGES_SQL},
a AS (SELECT min(origen) AS via, destino AS id FROM e WHERE origen = 'r1' GROUP BY destino),
b AS (SELECT min(origen) AS via, destino AS id FROM e JOIN a ON origen = a.id GROUP BY destino),
c AS (SELECT min(origen) AS via, destino AS id FROM e JOIN b ON origen = b.id GROUP BY destino)
SELECT id, 1 AS salto, via FROM a UNION ALL SELECT id, 2, via FROM b UNION ALL SELECT id, 3, via FROM c""")
def reach_by_joins(spark, sf):
    edges = _table_edges(spark, sf)
    return lineage.reach(edges.select(F.col("origen").alias("a"), F.col("destino").alias("b")), "r1", small=0)


@query(f"""WITH RECURSIVE {_TABLE_EDGES_SQL},
l AS (SELECT origen AS id, 0 AS nivel FROM e WHERE origen NOT IN (SELECT destino FROM e) UNION SELECT destino, nivel + 1 FROM l JOIN e ON id = origen)
SELECT id, max(nivel)::INT AS nivel FROM l GROUP BY id""")
def levels_by_joins(spark, sf):
    edges = _table_edges(spark, sf)
    return lineage.longest_levels(lineage.endpoints(edges), edges, small=0)


@query(f"""WITH RECURSIVE {_RING_SQL}, c AS (SELECT * FROM e WHERE origen <> destino),
t AS (SELECT origen AS a, destino AS b FROM c UNION SELECT a, destino FROM t JOIN c ON b = origen)
SELECT p.a AS id, min(p.b) AS componente FROM t p JOIN t q ON p.a = q.b AND p.b = q.a GROUP BY p.a""")
def cycle_members_by_joins(spark, sf):
    k = F.col("c_custkey") % 60
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    edges = x.table(spark, sf, "customer").select(name(k).alias("origen"), name((k * 2 + 1) % 60).alias("destino")).distinct()
    return lineage.strongly_connected(edges, small=0)


@query(f"WITH {_TABLE_EDGES_SQL} SELECT 'consume' AS lado, destino AS id FROM e WHERE origen = 'n3' UNION ALL SELECT 'produce', origen FROM e WHERE destino = 'n3'")
def neighbours(spark, sf):
    edges = _table_edges(spark, sf)
    graph = lineage.Graph(lineage.endpoints(edges), edges)
    return graph.consumers("n3").select(F.lit("consume").alias("lado"), "id").unionByName(graph.producers("n3").select(F.lit("produce").alias("lado"), "id"))


@query(f"WITH {x.EDGES_SQL}, {x.NODES_SQL} SELECT 'nodos' AS medida, count(*) AS valor FROM nodes UNION ALL SELECT 'tipo:' || tipo, count(*) FROM nodes GROUP BY tipo UNION ALL SELECT 'aristas', count(*) FROM edges UNION ALL SELECT 'confirmadas', count(*) FROM edges WHERE len(fuentes) > 1")
def graph_summary(spark, sf):
    return _graph(spark).summary()


@query(f"WITH {x.EDGES_SQL}, {x.NODES_SQL} SELECT id, tipo, capa, detalle, (SELECT count(*) FROM edges WHERE destino = id) AS entradas, (SELECT count(*) FROM edges WHERE origen = id) AS salidas FROM nodes")
def graph_listing(spark, sf):
    return _graph(spark).listing()


@query(f"{_GRAPH}, l AS (SELECT id, 0 AS nivel FROM nodes UNION ALL SELECT destino, nivel + 1 FROM l JOIN edges ON id = origen) SELECT id, max(nivel)::INT AS nivel FROM l GROUP BY id")
def levels(spark, sf):
    return _graph(spark).levels()


@query()
def layout(spark, sf):
    graph = _graph(spark)
    return spark.createDataFrame(lineage.layout([r["id"] for r in graph.nodes.select("id").collect()], graph.collected_edges()), "id string, nivel int, fila int, x double, y double")


@query(f"WITH {x.JOB_SQL} SELECT tabla, count(*) AS consultas, count(DISTINCT user_email) AS lectores, count(*) FILTER (NOT ends_with(user_email, '.gserviceaccount.com')) AS consultas_de_personas, list_sort(list(DISTINCT user_email))[1:20] AS quienes, max(creation_time) AS ultima_lectura, min(creation_time) AS primera_lectura, sum(total_bytes_billed)::BIGINT AS bytes_facturados FROM reads GROUP BY tabla")
def usage_rollup(spark, sf):
    return usage.reads(x.jobs(spark, sf), F.lit("1998-01-01").cast("timestamp"), 365)


_ORPHANS = ("p.d.t1", "p.d.t2", "p.d.none", "p.d.robots")


@query(f"""WITH {x.JOB_SQL}, r AS (SELECT CASE WHEN ends_with(user_email, '.gserviceaccount.com') AND tabla = 'p.d.t3' THEN 'p.d.robots' ELSE tabla END AS tabla, user_email FROM reads),
u AS (SELECT tabla, count(*) AS consultas, count(*) FILTER (NOT ends_with(user_email, '.gserviceaccount.com')) AS gente, list_sort(list(DISTINCT user_email))[1:20] AS quienes FROM r GROUP BY tabla)
SELECT o.tabla, coalesce(consultas, 0) AS consultas, coalesce(list_filter(quienes, lambda q: NOT ends_with(q, '.gserviceaccount.com')), []) AS personas,
  CASE WHEN coalesce(consultas, 0) = 0 THEN 'sin lecturas' WHEN gente > 0 THEN 'la usan personas' ELSE 'solo la tuberia' END AS veredicto, coalesce(consultas, 0) = 0 AS borrable
FROM (VALUES {x.values((o,) for o in _ORPHANS)}) o(tabla) LEFT JOIN u ON u.tabla = o.tabla""")
def verdicts(spark, sf):
    jobs = x.jobs(spark, sf)
    robots = F.col("user_email").endswith(usage.SERVICE)
    moved = jobs.withColumn("referenced_tables", F.transform("referenced_tables", lambda t: F.when(robots & (t["table_id"] == "t3"), t.withField("table_id", F.lit("robots"))).otherwise(t)))
    return usage.verdicts(spark.createDataFrame([(o,) for o in _ORPHANS], "id string"), usage.reads(moved, F.lit("1998-01-01").cast("timestamp"), 365))


# SQL texts, questions, evaluation

_SQLS = (
    (1, "SELECT * FROM p.raw.orders o JOIN `p.stg.lines` USING (k)"), (2, "-- was: p.old.table\nselect 1 from d.t /* join p.gone.x */"), (3, "MERGE INTO p.m.target USING p.m.source ON a = b"),
    (4, "CALL p.ops.refresh(1); INSERT INTO p.out.t SELECT 1"), (5, "select * from unnest(x)"), (6, None), (7, "with c as (select 1 from a.b) select * from c"),
)
_RE, _RE_CALL, _RE_NOTE = sqlrefs.AFTER_KEYWORD, sqlrefs.AFTER_CALL, sqlrefs.IN_COMMENT


@query(rf"""WITH t AS (SELECT n, coalesce(sql, '') AS sql FROM (VALUES {x.values(_SQLS)}) v(n, sql)), b AS (SELECT n, sql, regexp_replace(regexp_replace(sql, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g') AS bare, regexp_replace(sql, '(?s)/\*.*?\*/', ' ', 'g') AS noblock FROM t)
SELECT n, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(bare, '{_RE}', 1), regexp_extract_all(bare, '{_RE_CALL}', 1)), lambda q: lower(q)))) AS referencias,
  list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(list_concat(regexp_extract_all(sql, '((?s)/\*.*?\*/)', 1), regexp_extract_all(noblock, '(--[^\n]*)', 1)), chr(10)), '{_RE_NOTE}', 1), lambda q: lower(q)))) AS comentadas FROM b""")
def sql_refs_regex(spark, sf):
    texts = spark.createDataFrame(list(_SQLS), "n int, sql string")
    return texts.select("n", sqlrefs.references(F.col("sql")).alias("referencias"), sqlrefs.commented(F.col("sql")).alias("comentadas"))


@query("SELECT * FROM (VALUES (1, ['p.raw.orders', 'p.stg.lines'], []), (2, ['d.t'], ['p.gone.x', 'p.old.table']), (3, ['p.m.source', 'p.m.target'], []), (4, ['p.ops.refresh', 'p.out.t'], []), (5, [], []), (6, [], []), (7, ['a.b'], [])) t(n, referencias, comentadas)")
def sql_refs_parser(spark, sf):
    rows = [(n, sqlrefs.read(spark, sql)) for n, sql in _SQLS]
    return spark.createDataFrame([(n, sorted(r.references), sorted(r.commented)) for n, r in rows], "n int, referencias array<string>, comentadas array<string>")


_QUESTIONS = (
    (1, "¿Qué se rompe si toco raw.orders?", "impacto", "raw.orders", None, 0.9), (2, "¿De dónde sale `w.mart.sales` hasta dos saltos?", "linaje", "w.mart.sales", 2, 0.9), (3, "dime las tablas sin consumidores", "huerfanas", None, None, 0.9),
    (4, "¿Hay dependencias circulares?", "ciclos", None, None, 0.9), (5, "¿de dónde sale?", "linaje", None, None, 0.4), (6, "¿cuánto ha llovido?", "desconocida", None, None, 0.0), (7, "aguas abajo de mart_quality a 3 niveles", "impacto", "mart_quality", 3, 0.9), (8, "¿cuántas tablas hay?", "resumen", None, None, 0.9),
)


@query(f"SELECT * FROM (VALUES {x.values(_QUESTIONS)}) t(n, pregunta, operacion, tabla, saltos, confianza)")
def intent_match(spark, sf):
    read = ask.interpret(spark.createDataFrame([(q[0], q[1]) for q in _QUESTIONS], "n int, pregunta string"))
    return read.select("n", "pregunta", "operacion", "tabla", "saltos", "confianza")


@query("SELECT * FROM (VALUES (1, ['raw.orders', 'orders']), (2, ['w.mart.sales', 'mart', 'sales']), (3, []), (4, []), (5, []), (6, []), (7, ['mart_quality']), (8, [])) t(n, candidatos)")
def question_candidates(spark, sf):
    read = ask.interpret(spark.createDataFrame([(q[0], q[1]) for q in _QUESTIONS], "n int, pregunta string"))
    return read.select("n", "candidatos")


_CASES = ((1, "impacto", "impacto", ("a", "b", "c"), ("a", "b")), (2, "linaje", "impacto", (), ("x",)), (3, "ciclos", "ciclos", (), ()), (4, "linaje", "linaje", ("a",), ("a", "b", "c", "d")), (5, "resumen", "resumen", ("a", "b"), ("b", "a")), (6, "impacto", "impacto", ("q",), ()))
_CASE_SQL = f"""c AS (SELECT n, op, got_op, want, got, list_intersect(want, got) AS hit, len(want) = 0 AND len(got) = 0 AS ambos FROM (VALUES {", ".join(f"({n}, '{a}', '{b}', {x.array(w)}::VARCHAR[], {x.array(g)}::VARCHAR[])" for n, a, b, w, g in _CASES)}) t(n, op, got_op, want, got)),
pr AS (SELECT *, CASE WHEN ambos THEN 1.0 ELSE coalesce(len(hit)::DOUBLE / nullif(len(got), 0), 0) END AS p, CASE WHEN ambos THEN 1.0 ELSE coalesce(len(hit)::DOUBLE / nullif(len(want), 0), 0) END AS r FROM c),
sc AS (SELECT *, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS f2, len(hit) = len(want) AND len(hit) = len(got) AS exacta FROM pr)"""


def _cases(spark):
    return spark.createDataFrame([(n, a, b, list(w), list(g)) for n, a, b, w, g in _CASES], "n int, operacion string, operacion_dada string, esperadas array<string>, dadas array<string>")


@query(f"WITH {_CASE_SQL} SELECT n, list_sort(list_filter(want, lambda q: NOT list_contains(got, q))) AS faltan, list_sort(list_filter(got, lambda q: NOT list_contains(want, q))) AS sobran, round(p, 4)::DOUBLE AS precision, round(r, 4)::DOUBLE AS recall, round(f2, 4)::DOUBLE AS f2, exacta FROM sc")
def eval_metrics(spark, sf):
    return ask.scores(_cases(spark)).select("n", "faltan", "sobran", "precision", "recall", "f2", "exacta")


@query(f"WITH {_CASE_SQL} SELECT count(*) AS casos, round(avg(p), 4)::DOUBLE AS precision, round(avg(r), 4)::DOUBLE AS recall, round(avg(f2), 4)::DOUBLE AS f2, count(*) FILTER (exacta) AS exactas, count(*) FILTER (op = got_op) AS operaciones FROM sc")
def eval_report(spark, sf):
    return ask.report(ask.scores(_cases(spark)))


# planner, watermarks, messages, catalogs

_NOW, _ORIGIN = "2026-09-25 12:00:00", "2026-09-01 00:00:00"
_ASKED = ((551, 0), (1293, 1), (549, 2), (551, 3), (546, 4))
_MARKS = ((551, "2026-09-20 00:00:00"), (549, "2026-09-25 12:00:00"), (546, "2026-08-01 00:00:00"))
_WINDOW_SQL = f"""i AS (SELECT id AS indicador_id, min(pos) AS pos FROM (VALUES {x.values(_ASKED)}) t(id, pos) GROUP BY id), m AS (SELECT id AS indicador_id, hasta::TIMESTAMP AS hasta FROM (VALUES {x.values(_MARKS)}) t(id, hasta)),
b AS (SELECT indicador_id, pos, CASE WHEN hasta IS NULL THEN TIMESTAMP '{_ORIGIN}' ELSE greatest(TIMESTAMP '{_ORIGIN}', least(hasta, TIMESTAMP '{_NOW}' - INTERVAL 48 HOURS)) END AS b FROM i LEFT JOIN m USING (indicador_id)),
w AS (SELECT indicador_id, pos, unnest(generate_series(b, TIMESTAMP '{_NOW}', INTERVAL 7 DAYS)) AS inicio FROM b),
win AS (SELECT indicador_id, pos, row_number() OVER (PARTITION BY indicador_id ORDER BY inicio)::INT AS turno, inicio, least(inicio + INTERVAL 7 DAYS, TIMESTAMP '{_NOW}') AS fin FROM w WHERE inicio < TIMESTAMP '{_NOW}')"""


def _plan_inputs(spark):
    from datetime import datetime, timezone

    utc = lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc)
    asked = spark.createDataFrame(list(_ASKED), "indicador_id bigint, pos int")
    marks = spark.createDataFrame([(i, utc(h)) for i, h in _MARKS], "indicador_id bigint, hasta timestamp")
    return asked, marks, utc(_NOW), planner.Policy(utc(_ORIGIN), max_requests=5)


@query(f"WITH {_WINDOW_SQL} SELECT indicador_id::BIGINT AS indicador_id, pos, turno, inicio, fin FROM win")
def plan_windows(spark, sf):
    return planner.windows(*_plan_inputs(spark))


@query(f"WITH {_WINDOW_SQL} SELECT indicador_id::BIGINT AS indicador_id, pos, turno, inicio, fin FROM win ORDER BY turno, pos LIMIT 5")
def round_robin_budget(spark, sf):
    return planner.plan(*_plan_inputs(spark))


@query(f"""WITH {_WINDOW_SQL}, p AS (SELECT * FROM win ORDER BY turno, pos LIMIT 5)
SELECT indicador_id::BIGINT AS indicador_id, (SELECT count(*) FROM p WHERE p.indicador_id = i.indicador_id) AS planeadas, (SELECT count(*) FROM win WHERE win.indicador_id = i.indicador_id) - (SELECT count(*) FROM p WHERE p.indicador_id = i.indicador_id) AS pendientes,
  CASE WHEN (SELECT count(*) FROM win WHERE win.indicador_id = i.indicador_id) = 0 THEN 'al_dia' WHEN (SELECT count(*) FROM p WHERE p.indicador_id = i.indicador_id) = 0 THEN 'presupuesto_agotado' END AS motivo FROM i""")
def plan_pending(spark, sf):
    return planner.pending(*_plan_inputs(spark))


@query(f"""WITH {_WINDOW_SQL}, p AS (SELECT * FROM win ORDER BY turno, pos LIMIT 2),
q AS (SELECT CASE WHEN (SELECT count(*) FROM win WHERE win.indicador_id = i.indicador_id) = 0 THEN 'al_dia' WHEN (SELECT count(*) FROM p WHERE p.indicador_id = i.indicador_id) = 0 THEN 'presupuesto_agotado' END AS motivo FROM i)
SELECT motivo, count(*) AS indicadores FROM q WHERE motivo IS NOT NULL GROUP BY motivo""")
def plan_skipped(spark, sf):
    asked, marks, now, policy = _plan_inputs(spark)
    return planner.skipped(planner.pending(asked, marks, now, replace(policy, max_requests=2)))


@query("SELECT user_id AS indicador_id, arg_max(ts, ts) AS hasta, max(ts) AS actualizado_en FROM events GROUP BY user_id")
def watermark_upsert(spark, sf):
    e = x.table(spark, sf, "events").select(F.col("user_id").alias("indicador_id"), F.col("ts").cast("timestamp").alias("hasta"), F.col("event_id"))
    top = lambda df: df.groupBy("indicador_id").agg(F.max("hasta").alias("hasta")).withColumn("actualizado_en", F.col("hasta"))
    return store.advanced(top(e.where("event_id % 2 = 0")), top(e.where("event_id % 2 = 1")))


_BAD = ("{no json", "[1, 2, 3]", '{"instante": "2026-09-29T10:00:00Z", "valor": 1}', '{"indicador_id": 1, "instante": "ayer", "valor": 1}', '{"indicador_id": 1, "instante": "2026-09-29T10:00:00", "valor": 1}', '{"indicador_id": "x", "instante": "2026-09-29T10:00:00Z", "valor": 1}', '{"indicador_id": 1, "instante": "2026-09-29T10:00:00Z", "valor": "nada"}', '{"valor": 2}')


@query(f"""WITH m AS (SELECT '{{"indicador_id":' || user_id || ',"instante":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","valor":' || k::INT || '}}' AS value FROM (SELECT user_id, ts, json_extract(props, '$.k') AS k FROM events)
 UNION ALL SELECT * FROM (VALUES {x.values((b,) for b in _BAD)}) t(value)),
g AS (SELECT value, CASE WHEN NOT json_valid(value) THEN 'JSONDecodeError' WHEN json_type(value) <> 'OBJECT' THEN 'TypeError' WHEN NOT list_has_all(json_keys(value), ['indicador_id', 'instante', 'valor']) THEN 'ValueError: faltan'
  WHEN NOT regexp_matches(value->>'instante', '(Z|[+-]\\d\\d:?\\d\\d)$') OR try_cast(value->>'instante' AS TIMESTAMPTZ) IS NULL OR try_cast(value->>'indicador_id' AS BIGINT) IS NULL OR try_cast(value->>'valor' AS DOUBLE) IS NULL THEN 'ValueError: valor' ELSE 'ok' END AS clase FROM m)
SELECT clase, count(*) AS n FROM g GROUP BY clase""")
def json_gate(spark, sf):
    e = x.table(spark, sf, "events").select(F.format_string('{"indicador_id":%d,"instante":"%s","valor":%d}', "user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.get_json_object("props", "$.k").cast("int")).alias("value"))
    read = gates.interpreted(gates.decoded(e.unionByName(spark.createDataFrame([(b,) for b in _BAD], "value string"))))
    kind = F.when(F.col("motivo").isNull(), "ok").when(F.col("motivo").startswith("ValueError: faltan"), "ValueError: faltan").when(F.col("motivo").startswith("ValueError"), "ValueError: valor").otherwise(F.split("motivo", ":")[0])
    return read.groupBy(kind.alias("clase")).agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT * FROM (VALUES {x.values((b,) for b in _BAD)}) t(value)
 UNION ALL SELECT '{{"indicador_id":' || event_id || ',"valor":1}}' FROM events WHERE event_type = 'error'
 UNION ALL SELECT '{{"indicador_id":' || event_id || ',"instante":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","valor":1}}' FROM events)
SELECT value AS original, CASE WHEN NOT json_valid(value) THEN 'JSONDecodeError' WHEN json_type(value) <> 'OBJECT' THEN 'TypeError' ELSE 'ValueError' END AS clase
FROM m WHERE NOT coalesce(try_cast(value->>'indicador_id' AS BIGINT) IS NOT NULL AND regexp_matches(value->>'instante', '(Z|[+-]\\d\\d:?\\d\\d)$') AND try_cast(value->>'instante' AS TIMESTAMPTZ) IS NOT NULL AND try_cast(value->>'valor' AS DOUBLE) IS NOT NULL, FALSE)""".replace("FROM m WHERE NOT coalesce(", "FROM m WHERE NOT json_valid(value) OR NOT coalesce("))
def stream_rejects(spark, sf):
    e = x.table(spark, sf, "events")
    short = e.where("event_type = 'error'").select(F.format_string('{"indicador_id":%d,"valor":1}', "event_id").alias("value"))
    whole = e.select(F.format_string('{"indicador_id":%d,"instante":"%s","valor":1}', "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("value"))
    _, rejects = gates.split(spark.createDataFrame([(b,) for b in _BAD], "value string").unionByName(short).unionByName(whole), F.current_timestamp())
    return rejects.select("original", F.split("motivo", ":")[0].alias("clase"))


_BODY = '{"indicator": {"id": 551, "name": "Eolica", "values": [{"value": 1.5, "datetime_utc": "2026-09-24T00:00:00Z", "geo_id": 8741, "geo_name": "P"}, {"value": null, "datetime_utc": "2026-09-24T00:05:00Z"}, {"value": 2.5, "datetime": "2026-09-24T02:10:00+02:00", "geo_id": 8741, "geo_name": "P"}, {"value": 9.0, "datetime_utc": "2026-09-25T00:00:00Z"}, {"value": 3.0}, {"value": 4.0, "datetime": "2026-09-24T05:00:00"}]}}'


@query("SELECT 551::BIGINT AS indicador_id, t::TIMESTAMP AS instante, v AS valor, g::BIGINT AS geo_id, n AS geo_nombre FROM (VALUES ('2026-09-24 00:00:00', 1.5::DOUBLE, 8741, 'P'), ('2026-09-24 00:10:00', 2.5, 8741, 'P'), ('2026-09-24 05:00:00', 4.0, NULL, NULL)) q(t, v, g, n)")
def api_response(spark, sf):
    body = spark.createDataFrame([(_BODY,)], "body string").withColumns({"inicio": F.lit("2026-09-24T00:00:00Z").cast("timestamp"), "fin": F.lit("2026-09-25T00:00:00Z").cast("timestamp")})
    return api.readings(body)


@query("SELECT c_custkey AS id, c_name AS nombre FROM customer WHERE contains(lower(strip_accents(c_name)), '1') ORDER BY id LIMIT 40")
def catalog_search(spark, sf):
    return metadata.Catalog(x.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"))).search("1")


@query("SELECT DISTINCT l_partkey + 100 AS id FROM lineitem WHERE l_partkey + 100 NOT IN (SELECT p_partkey FROM part)")
def catalog_missing(spark, sf):
    parts = metadata.Catalog(x.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("nombre")))
    return parts.missing(x.table(spark, sf, "lineitem").select((F.col("l_partkey") + 100).alias("id")))


_MANIFEST = '{"nodes": {"model.a.s": {"resource_type": "model", "database": "P", "schema": "stg", "alias": "S", "name": "s0", "description": "d", "path": "staging/s.sql"}, "test.a.t": {"resource_type": "test", "database": "P", "schema": "x", "name": "t", "path": "t.sql"}, "seed.a.k": {"resource_type": "seed", "database": "P", "schema": "stg", "name": "k", "path": "seeds/k.csv"}}, "sources": {"source.a.r": {"resource_type": "source", "database": "P", "schema": "raw", "identifier": "R1", "name": "r", "path": "models/staging/s.yml"}}, "parent_map": {"model.a.s": ["source.a.r", "seed.a.k"], "test.a.t": ["model.a.s"]}}'


@query("SELECT * FROM (VALUES ('p.raw.r1', 'p.stg.s', 'manifiesto'), ('p.stg.k', 'p.stg.s', 'manifiesto')) t(origen, destino, motivo)")
def manifest_edges(spark, sf):
    return metadata.from_manifest(spark.createDataFrame([(_MANIFEST,)], "value string"))[1]


@query("SELECT * FROM (VALUES ('p.raw.r1', 'fuente', 'staging', ''), ('p.stg.k', 'semilla', 'seeds', ''), ('p.stg.s', 'modelo', 'staging', 'd')) t(id, tipo, capa, detalle)")
def manifest_nodes(spark, sf):
    return metadata.from_manifest(spark.createDataFrame([(_MANIFEST,)], "value string"))[0]


@query("SELECT * FROM (VALUES ('p.d.t', 'p.d.v', 'catalogo'), ('p.e.u', 'p.d.f', 'catalogo')) t(origen, destino, motivo)")
def catalog_edges(spark, sf):
    tables = spark.createDataFrame([("d", "t", "BASE TABLE"), ("d", "v", "VIEW")], "table_schema string, table_name string, table_type string")
    views = spark.createDataFrame([("d", "v", "SELECT * FROM d.t JOIN p.d.v USING (k)")], "table_schema string, table_name string, view_definition string")
    routines = spark.createDataFrame([("d", "f", "PROCEDURE", "INSERT INTO e.u SELECT 1")], "routine_schema string, routine_name string, routine_type string, ddl string")
    return metadata.from_catalog(tables, views, routines, "p")[1]


def _decisions(spark, sf):
    """Every order as a decision: some lack a title, links lead five keys on, alternatives and dates are often wrong."""
    o = x.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    link = lambda kind, c: F.struct(F.lit(kind).alias("tipo"), name(c).alias("destino"))
    none = F.array().cast("array<struct<tipo:string,destino:string>>")
    question = lambda c: F.concat(F.lit("q"), c.cast("string"))
    links = F.concat(F.array(link("causada_por", key + 5)), F.when(key % 2 == 0, F.array(link("supera_a", key + 5))).otherwise(none), F.when(key % 3 == 0, F.array(link("superada_por", key - 5))).otherwise(none))
    return o.select(
        name(key).alias("id"),
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("titulo"),
        F.to_date("o_orderdate").alias("fecha"),
        (key % 3).cast("int").alias("orden"),
        F.col("o_orderpriority").alias("carril"),
        (key % 2 == 0).alias("publica"),
        links.alias("enlaces"),
        (key % 40).cast("string").alias("commit"),
        F.array(F.struct((key % 2 == 0).alias("elegida"), F.lit("r").alias("motivo")), F.struct((key % 3 == 0).alias("elegida"), F.when(key % 10 != 0, "s").alias("motivo"))).alias("alternativas"),
        F.array(question(key)).alias("abre"),
        F.when(key % 2 == 0, F.array(question(key - 1))).otherwise(F.array().cast("array<string>")).alias("cierra"),
        F.date_add(F.to_date("o_orderdate"), (key % 5).cast("int")).alias("fecha_commit"))


_LINKS_SQL = """l AS (
  SELECT o_orderkey AS k, 'causada_por' AS tipo, o_orderkey + 5 AS d FROM orders
  UNION ALL SELECT o_orderkey, 'supera_a', o_orderkey + 5 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'superada_por', o_orderkey - 5 FROM orders WHERE o_orderkey % 3 = 0)"""
_CHOSEN_SQL = "(o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT"


@query(f"""WITH {_LINKS_SQL}
SELECT 'incompletas' AS control, count(*) AS filas FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT 'enlaces sueltos', count(*) FROM l WHERE d NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'mal elegidas', count(*) FROM orders WHERE {_CHOSEN_SQL} <> 1 OR o_orderkey % 10 = 0
UNION ALL SELECT 'fuera de vocabulario', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'orden repetido', count(*) FROM (SELECT o_orderdate::DATE AS f, o_orderkey % 3 AS k FROM orders GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'publicas', count(*) FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'commits con deriva', count(DISTINCT o_orderkey % 40) FROM orders WHERE o_orderkey % 5 > 1
UNION ALL SELECT 'carriles', count(DISTINCT o_orderpriority) FROM orders""")
def register_checks(spark, sf):
    return _register_counts(_decisions(spark, sf))


@query("SELECT 'd' || o_orderkey AS id, o_orderdate::DATE AS fecha FROM orders WHERE o_orderkey % 17 = 0")
def register_incomplete(spark, sf):
    return register.incomplete(_decisions(spark, sf)).select("id", "fecha")


@query(f"WITH {_LINKS_SQL} SELECT 'd' || k AS id, tipo, 'd' || d AS destino FROM l WHERE d NOT IN (SELECT o_orderkey FROM orders)")
def register_dangling(spark, sf):
    return register.dangling(_decisions(spark, sf))


@query(f"""WITH {_LINKS_SQL}, a AS (SELECT k, d FROM l WHERE tipo = 'supera_a'), b AS (SELECT d AS k, k AS d FROM l WHERE tipo = 'superada_por')
SELECT 'd' || k AS id, 'd' || d AS destino FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'd' || k, 'd' || d FROM (FROM b EXCEPT ALL FROM a)""")
def register_one_sided(spark, sf):
    return register.one_sided(_decisions(spark, sf))


@query(f"SELECT 'd' || o_orderkey AS id, {_CHOSEN_SQL} AS elegidas FROM orders WHERE {_CHOSEN_SQL} <> 1 OR o_orderkey % 10 = 0")
def register_badly_chosen(spark, sf):
    return register.badly_chosen(_decisions(spark, sf))


@query("SELECT o_orderdate::DATE AS fecha, (o_orderkey % 3)::INT AS orden, count(*) AS veces, list_sort(list('d' || o_orderkey)) AS ids FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def register_clashing(spark, sf):
    return register.clashing_order(_decisions(spark, sf))


@query("SELECT (o_orderkey % 40)::VARCHAR AS commit, count(*) AS decisiones, max(o_orderkey % 5)::INT AS dias FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1")
def register_drifted(spark, sf):
    return register.drifted(_decisions(spark, sf)).select("commit", F.size("ids").cast("long").alias("decisiones"), "dias")


@query("SELECT 'q' || o_orderkey AS cuestion, 'd' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 1 FROM orders WHERE o_orderkey % 2 = 0)")
def register_open_questions(spark, sf):
    return register.open_questions(_decisions(spark, sf))


def _register_counts(d):
    parts = (("incompletas", register.incomplete(d)), ("enlaces sueltos", register.dangling(d)), ("mal elegidas", register.badly_chosen(d)), ("fuera de vocabulario", register.outside_vocabulary(d, "carril", ("1-URGENT", "2-HIGH"))), ("orden repetido", register.clashing_order(d)), ("publicas", register.public(d)), ("commits con deriva", register.drifted(d)), ("carriles", register.inventory(d)))
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("filas")).select(F.lit(name).alias("control"), "filas")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, date_trunc('hour', ts) AS hora, ts::DATE AS dia, extract(hour FROM ts)::INT AS hora_num, epoch_us(ts) AS micros, CASE WHEN event_id % 2 = 0 THEN lower(strip_accents('Generación EÓLICA')) ELSE 'x' END AS llano, round(value / nullif(event_id % 3, 0), 4) AS razon FROM events")
def scalar_functions(spark, sf):
    e = x.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.date_trunc("hour", "t").alias("hora"), F.to_date("t").alias("dia"), F.hour("t").alias("hora_num"), F.unix_micros("t").alias("micros"), F.when(F.col("event_id") % 2 == 0, scalars.folded(F.lit("Generación EÓLICA"))).otherwise("x").alias("llano"), scalars.ratio(F.col("value"), F.col("event_id") % 3).alias("razon"))


@query(f"WITH {x.READINGS_SQL} SELECT date_trunc('hour', instante) AS hora, indicador_id, round(avg(valor), 4) AS potencia_media_mw, round(min(valor), 4) AS potencia_min_mw, round(max(valor), 4) AS potencia_max_mw, count(*) AS lecturas, count(*) = {x.PER_HOUR} AS hora_completa FROM raw GROUP BY ALL")
def stream_hourly_panes(spark, sf):
    from tidewell.streaming import replay

    panes = replay.last_panes(spark, x.readings(spark, sf), x.PER_HOUR)
    return panes.withColumns({c: rounded_like_oracle(c) for c in ("potencia_media_mw", "potencia_min_mw", "potencia_max_mw")})


_ARRIVAL_DAYS = 9


@query(f"""WITH e AS (SELECT event_id % 40 + 1 AS indicador_id, ts, value, floor(date_diff('day', (SELECT min(ts) FROM events)::DATE, (ts + (event_id % 5) * INTERVAL 20 HOURS)::DATE) / {_ARRIVAL_DAYS}) AS lote FROM events),
w AS (SELECT l.lote, (SELECT max(epoch_ms(ts)) FROM e WHERE e.lote < l.lote) AS agua FROM (SELECT DISTINCT lote FROM e) l),
r AS (SELECT indicador_id, date_trunc('hour', ts) AS hora, value, coalesce(agua, 0) AS agua, epoch_ms(date_trunc('hour', ts)) + 3600000 AS fin FROM e JOIN w USING (lote)),
k AS (SELECT * FROM r WHERE agua < fin + 48 * 3600000),
g AS (SELECT hora, indicador_id, count(*) FILTER (agua < fin) AS a_tiempo, count(*) FILTER (agua >= fin) AS tardios, count(*) AS lecturas, avg(value) AS media FROM k GROUP BY ALL)
SELECT hora, indicador_id, (a_tiempo > 0)::BIGINT + tardios AS paneles, tardios, (a_tiempo > 0)::BIGINT + tardios - 1 AS ultimo, lecturas, round(media, 4) AS potencia_media_mw FROM g""")
def stream_late_panes(spark, sf):
    """Readings in the order of their arrival, up to eighty hours late, in micro-batches of some days: every pane, and what lateness drops."""
    from tidewell.streaming import replay

    e = x.table(spark, sf, "events").select((F.col("event_id") % 40 + 1).alias("indicador_id"), F.col("ts").cast("timestamp").alias("instante"), F.col("value").alias("valor"), "event_id")
    first = e.agg(F.min("instante").alias("first"))
    came = F.to_date(F.timestamp_millis(F.unix_millis("instante") + (F.col("event_id") % 5) * 20 * 3_600_000))
    e = e.crossJoin(F.broadcast(first)).withColumn("lote", F.floor(F.datediff(came, F.to_date("first")) / _ARRIVAL_DAYS).cast("int"))
    last = e.agg(F.max("lote")).first()[0]
    batches = [e.where(F.col("lote") == i).select("indicador_id", "instante", "valor") for i in range((last if last is not None else -1) + 1)]
    panes = replay.all_panes(spark, batches, x.PER_HOUR)
    newest = F.max_by(F.struct("lecturas", "potencia_media_mw"), "panel")
    out = panes.groupBy("hora", "indicador_id").agg(F.count("*").alias("paneles"), F.count_if("es_tardio").alias("tardios"), F.max("panel").alias("ultimo"), newest.alias("r"))
    return out.select("hora", "indicador_id", "paneles", "tardios", "ultimo", "r.lecturas", "r.potencia_media_mw")
