import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.sources import api, metadata, store

T0 = datetime(2026, 9, 24, tzinfo=timezone.utc)


def test_retries_only_what_may_pass():
    answers = [(503, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, '"ok"')]
    waits = []
    body, attempts = api.fetch(lambda u, h: answers[len(waits)], "u", {}, sleep=waits.append)
    assert (body, attempts, waits) == ('"ok"', 3, [1.0, 7.0])
    with pytest.raises(api.RequestFailed):
        api.fetch(lambda u, h: (404, {}, ""), "u", {}, sleep=waits.append)
    with pytest.raises(api.BudgetSpent):
        api.fetch(lambda u, h: (503, {}, ""), "u", {}, sleep=lambda s: None, budget=[2])


def test_api_reader_makes_a_partition_for_each_window():
    windows = [[551, "2026-09-24T00:00:00+00:00", "2026-09-25T00:00:00+00:00"]] * 3
    reader = api._Reader({"url": "http://x", "windows": json.dumps(windows), "max_requests": "3"})
    assert len(reader.partitions()) == 3
    reader.transport = lambda u, h: (200, {}, '{"indicator": {}}')
    assert next(iter(reader.read(reader.partitions()[0])))[3] == '{"indicator": {}}'
    with pytest.raises(api.BudgetSpent):
        api._Reader({"url": "http://x", "windows": json.dumps(windows), "max_requests": "2"}).partitions()


def test_failures_say_how_often_was_asked():
    def fails(transport, **options):
        with pytest.raises(api.RequestFailed) as e:
            api.fetch(transport, "u", {}, sleep=lambda s: None, **options)
        return e.value.code, e.value.attempts

    def dead(u, h):
        raise TimeoutError("timed out")

    assert fails(lambda u, h: (404, {}, "")) == (404, 1) and fails(lambda u, h: (503, {}, "")) == (503, 3)
    assert fails(dead) == (None, 3) and fails(dead, tries=1) == (None, 1) and fails(lambda u, h: (200, {}, "<html>")) == (200, 1)


def test_retries_stay_within_the_budget():
    for windows in range(1, 20):
        for most in range(windows, 70):
            given = api.allowances(windows, most)
            assert len(given) == windows and sum(given) <= most and all(1 <= n <= api.TRIES for n in given)
            assert sum(given) == min(most, windows * api.TRIES)


def test_append_keeps_versions_and_reads_days(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, 1.0, None, None), (1, T0 + timedelta(days=1), 2.0, 3, "z")], "indicador_id bigint, instante timestamp, valor double, geo_id bigint, geo_nombre string")
    path = str(tmp_path / "raw")
    assert store.append_readings(rows, path, F.lit(T0).cast("timestamp")) == 2
    assert store.append_readings(rows, path, F.lit(T0).cast("timestamp")) == 2
    assert store.append_readings(rows.where("false"), path, F.lit(T0).cast("timestamp")) == 0
    assert store.load(spark, path, schemas.READINGS).count() == 4
    day = store.between_days(spark, path, schemas.READINGS, F.lit(T0).cast("timestamp"), F.lit(T0 + timedelta(days=1)).cast("timestamp"))
    assert day.count() == 2
    with pytest.raises(Exception, match="valor is required"):
        store.append_readings(rows.withColumn("valor", F.lit(None).cast("double")), path, F.lit(T0).cast("timestamp"))


def test_watermarks_never_go_back(spark, tmp_path):
    marks = store.Watermarks(spark, str(tmp_path / "marks"))
    assert marks.load().count() == 0
    now = F.lit(T0).cast("timestamp")
    frame = lambda *r: spark.createDataFrame(list(r), "indicador_id bigint, hasta timestamp")
    marks.advance(frame((1, T0), (2, T0)), now)
    got = marks.advance(frame((1, T0 - timedelta(days=1)), (2, T0 + timedelta(days=1)), (3, T0)), now)
    assert {r["indicador_id"]: r["hasta"].replace(tzinfo=timezone.utc) for r in got.collect()} == {1: T0, 2: T0 + timedelta(days=1), 3: T0}


def test_seed_and_catalog(spark, tmp_path):
    seed = tmp_path / "seed.csv"
    seed.write_text('indicador_id,tecnologia,familia,renovable,min_mw,max_mw,nota_rango,sumable,orden_apilado\n546,Hidro,generacion,true,-6000,20000,"suelo, negativo",true,7\n')
    row = store.read_seed(spark, str(seed)).first()
    assert row["min_mw"] == -6000.0 and row["nota_rango"] == "suelo, negativo" and row["renovable"] is True
    for body in ('[{"id": 2, "name": "Eólica"}, {"id": 1, "name": "Uno"}]', '{"fuente": "x", "indicadores": [{"id": 2, "nombre": "Eólica"}]}'):
        path = tmp_path / "c.json"
        path.write_text(body)
        catalog = metadata.Catalog.load(spark, str(path))
        assert [r["id"] for r in catalog.search("EOLICA").collect()] == [2]
    assert [r["id"] for r in catalog.missing(spark.createDataFrame([(9,), (2,), (7,)], "id bigint")).collect()] == [7, 9]
    path.write_text("[]")
    with pytest.raises(ValueError):
        metadata.Catalog.load(spark, str(path))


def test_schema_files_list_columns_in_order():
    for table in schemas.ALL:
        assert [c["name"] for c in json.loads(table.to_json())] == [f.name for f in table.schema]


def test_accents_go_by_decomposition(spark):
    from tidewell.functions import scalars

    texts = ["Ñandú ÇÀ", "ŁÓDŹ ǅ", "ἀρχή", "Việt Nam", "e\u0301", "ß", "й"]
    strip = lambda t: "".join(c for c in __import__("unicodedata").normalize("NFD", t.lower()) if not __import__("unicodedata").combining(c))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.folded(F.col("t"))).collect()]
    assert got == [strip(t) for t in texts]


def test_names_of_layers():
    assert store.dataset_name("marts", "prod") == "marts" and store.dataset_name("marts", "dev") == "dev_marts"
