from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewell.operators import checks, planner, series

T0 = datetime(2026, 9, 29, 10, tzinfo=timezone.utc)
RAW = "indicador_id bigint, instante timestamp, valor double, geo_id bigint, geo_nombre string, ingerido_en timestamp"
TEC = "indicador_id bigint, tecnologia string, familia string, renovable boolean, min_mw double, max_mw double, sumable boolean, orden_apilado bigint"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def hour(indicator, start, values, geo=1, at=T0):
    return [(indicator, start + timedelta(minutes=5 * i), float(v), geo, "zona", at) for i, v in enumerate(values)]


def technologies(spark):
    return spark.createDataFrame([(1, "a", "generacion", True, 0.0, 500.0, True, 1), (2, "b", "generacion", False, 0.0, 500.0, True, 2), (1293, "d", "demanda", None, 0.0, 900.0, True, 99)], TEC)


def test_latest_takes_last_ingested_then_highest(spark):
    later = T0 + timedelta(hours=1)
    rows = [(1, T0, 5.0, None, None, T0), (1, T0, 7.0, None, None, later), (1, T0, 6.0, None, None, later), (1, T0, 9.0, 3, "z", T0)]
    staged = series.staged_readings(raw(spark, rows))
    assert sorted((r["geo_id"] or 0, r["potencia_mw"]) for r in staged.collect()) == [(0, 7.0), (3, 9.0)]
    by_sort = series.latest(raw(spark, rows), series.POINT, ("ingerido_en", "valor"))
    assert sorted(by_sort.select("valor").collect()) == sorted(staged.select("potencia_mw").collect())


def test_hour_is_complete_with_exactly_twelve(spark):
    rows = hour(1, T0, range(12)) + hour(1, T0 + timedelta(hours=1), range(11))
    got = {r["hora"]: r for r in series.hourly(series.staged_readings(raw(spark, rows)), technologies(spark)).collect()}
    full, part = sorted(got.items())
    assert full[1]["hora_completa"] and full[1]["potencia_media_mw"] == 5.5 and abs(full[1]["energia_mwh"] - 5.5) < 1e-9
    assert not part[1]["hora_completa"] and part[1]["lecturas"] == 11


def test_mart_share_is_null_unless_covered(spark):
    rows = hour(1, T0, [100] * 12) + hour(2, T0, [300] * 12) + hour(1293, T0, [400] * 12) + hour(1, T0 + timedelta(hours=1), [100] * 12)
    hours = series.hourly(series.staged_readings(raw(spark, rows)), technologies(spark))
    mart = series.generation_mart(hours, technologies(spark))
    first, second = mart.orderBy("hora").collect()
    assert first["porcentaje_renovable"] == 25.0 and first["razon_generacion_demanda"] == 1.0 and first["cobertura_completa"] and first["horas_de_antiguedad"] == 1
    assert second["porcentaje_renovable"] is None and second["demanda_mw"] is None and second["es_ultima_hora"]
    shares = {(r["indicador_id"], r["hora"]): r["porcentaje_del_mix"] for r in series.technology_mart(hours, mart).collect()}
    assert sorted(x for x in shares.values() if x is not None) == [25.0, 75.0] and None in shares.values()


def test_null_zone_never_joins_demand(spark):
    rows = hour(1, T0, [1] * 12, geo=None) + hour(2, T0, [1] * 12, geo=None) + hour(1293, T0, [1] * 12, geo=None)
    hours = series.hourly(series.staged_readings(raw(spark, rows)), technologies(spark))
    assert series.generation_mart(hours, technologies(spark)).first()["demanda_mw"] is None


def test_empty_tables(spark):
    hours = series.hourly(series.staged_readings(raw(spark, [])), technologies(spark))
    assert hours.count() == 0 and series.generation_mart(hours, technologies(spark)).count() == 0
    assert series.reconcile(hours, hours).first()["horas"] == 0


def test_unknown_outcome_is_neither(spark):
    rows = [(T0, 1, T0, T0 + timedelta(hours=25, minutes=59), 200, 1, 288, 1.5, None), (T0, 1, T0, T0, 503, 3, 0, 1.0, "HTTP 503"), (T0, 1, T0, T0, None, 2, 0, 1.0, None)]
    audit = spark.createDataFrame(rows, "momento timestamp, indicador_id bigint, ventana_inicio timestamp, ventana_fin timestamp, codigo bigint, intentos bigint, puntos bigint, segundos double, error string")
    staged = series.staged_requests(audit)
    assert [r["horas_pedidas"] for r in staged.orderBy("intentos").collect()][0] == 25
    day = series.daily_requests(staged).first()
    assert (day["peticiones"], day["peticiones_ok"], day["peticiones_fallidas"], day["intentos_http"]) == (3, 1, 1, 6)


def test_sum_or_mean(spark):
    fine = raw(spark, hour(551, T0, [2692.25] * 12))
    coarse = spark.createDataFrame([(551, T0, 32307.0)], "indicador_id bigint, hora timestamp, valor double")
    assert series.sum_or_mean(fine, coarse).first()["veredicto"] == "SUM"


def test_checks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 50.0)], "k int, v double")
    assert checks.between(df, "v", 10, 60).count() == 1
    assert checks.unique(df, "k").collect()[0]["veces"] == 2
    assert checks.not_null(df, "v").count() == 1
    assert checks.freshness(df.where("false").withColumn("t", F.current_timestamp()), "t", F.current_timestamp()).first()["estado"] == "error"
    staged = spark.createDataFrame([(1, T0, 600.0), (9, T0, 1.0), (2, T0, 3.0)], "indicador_id bigint, instante timestamp, potencia_mw double")
    hours = spark.createDataFrame([], "indicador_id bigint, hora timestamp, potencia_media_mw double")
    assert sorted(r["motivo"] for r in checks.plausible_by_group(staged, hours, technologies(spark)).collect()) == ["por encima", "sin declarar"]


NOW = datetime(2026, 9, 25, 12, tzinfo=timezone.utc)
ORIGIN = datetime(2026, 9, 1, tzinfo=timezone.utc)


def test_planner_budget_is_shared(spark):
    asked = spark.createDataFrame([(551, 0), (549, 1), (551, 2)], "indicador_id bigint, pos int")
    marks = spark.createDataFrame([], "indicador_id bigint, hasta timestamp")
    policy = planner.Policy(ORIGIN, days_per_window=1, max_requests=4)
    assert planner.windows(asked, marks, NOW, policy).count() == 50
    assert [r["indicador_id"] for r in planner.plan(asked, marks, NOW, policy).collect()] == [551, 549, 551, 549]
    assert {r["indicador_id"]: r["pendientes"] for r in planner.pending(asked, marks, NOW, policy).collect()} == {551: 23, 549: 23}


def test_planner_rereads_the_revisable_window(spark):
    asked = spark.createDataFrame([(1, 0), (2, 1)], "indicador_id bigint, pos int")
    marks = spark.createDataFrame([(1, NOW), (2, ORIGIN - timedelta(days=9))], "indicador_id bigint, hasta timestamp")
    got = {r["indicador_id"]: r["inicio"].replace(tzinfo=timezone.utc) for r in planner.plan(asked, marks, NOW, planner.Policy(ORIGIN, days_per_window=100)).collect()}
    assert got == {1: NOW - timedelta(hours=48), 2: ORIGIN}
