from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.streaming import flow, gates, panes

HOUR = datetime(2025, 3, 11, 10, tzinfo=timezone.utc)


def message(at, value, indicator=77):
    return f'{{"indicador_id": {indicator}, "instante": "{at}", "valor": {value}}}'


def feed(spark, tmp_path, batches, **options):
    """Each batch is a file, taken by a micro-batch of its own."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, lines in enumerate(batches):
        (source / f"{i:03}.txt").write_text("\n".join(lines) + "\n")
        stream = flow.messages(spark, str(source), files_per_trigger=1)
        assert flow.run(stream, str(out), str(tmp_path / "state"), available_now=True, **options)
    rows = spark.read.parquet(str(out / "panes")).where("indicador_id > 0").orderBy("panel").collect()
    rejects = spark.read.parquet(str(out / "rejects")).collect()
    return rows, rejects


FAR = message("2025-07-01T00:00:00Z", 0, -1)


def test_late_reading_makes_a_second_pane(spark, tmp_path):
    rows, rejects = feed(spark, tmp_path, [[message("2025-03-11T10:05:00Z", 640)], [message("2025-03-11T12:00:00Z", 1, -1)], [message("2025-03-11T10:10:00+00:00", 260)], [FAR], [FAR]])
    assert [(r["potencia_media_mw"], r["panel"], r["es_tardio"], r["lecturas"]) for r in rows] == [(640.0, 0, False, 1), (450.0, 1, True, 2)]
    assert not rejects


def test_beyond_the_tolerance_is_dropped(spark, tmp_path):
    rows, _ = feed(spark, tmp_path, [[message("2025-03-11T10:05:00Z", 640)], [message("2025-03-13T11:00:00Z", 1, -1)], [message("2025-03-11T10:10:00Z", 9)], [FAR], [FAR]])
    assert [(r["potencia_media_mw"], r["panel"]) for r in rows] == [(640.0, 0)]


def test_just_inside_the_tolerance_counts(spark, tmp_path):
    rows, _ = feed(spark, tmp_path, [[message("2025-03-11T10:05:00Z", 10)], [message("2025-03-13T10:45:00Z", 1, -1)], [message("2025-03-11T10:10:00Z", 20)], [FAR], [FAR]])
    assert [r["potencia_media_mw"] for r in rows] == [10.0, 15.0]


def test_readings_are_added_one_after_another_in_order_of_instants(spark, tmp_path):
    values = [44.66, 123.42, 121.97, 5.65, 32.77, 23.42, 8.37, 81.59]
    total = 0.0
    for v in values:
        total += v
    assert total != sum(sorted(values))
    lines = [message(f"2025-03-11T10:{5 * i:02}:00Z", v) for i, v in enumerate(values)]
    rows, _ = feed(spark, tmp_path, [lines[::-1], [FAR], [FAR]])
    assert [r["potencia_media_mw"] for r in rows] == [total / 8]


def test_hourly_panes_equal_their_sql_where_means_end_in_a_tie(spark):
    import duckdb

    from tidewell.plans import registry

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(registry.ORACLE_SQL["stream_hourly_panes"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["stream_hourly_panes"](spark, sf).collect())) == sorted(want)
    odd = [44.64125, -57.996249999999996, 0.00005, -0.0, 0.0, 1e300, -1e15, 3.3e14 + 0.0625, float("inf"), None]
    got = spark.createDataFrame([(v,) for v in odd], "v double").select(registry.rounded_like_oracle("v")).collect()
    assert [r[0] for r in got] == [con.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in odd]


def test_malformed_messages_are_rejected_whole(spark):
    bad = ["{no", "[1, 2]", '{"indicador_id": 1, "valor": 2}', '{"indicador_id": 1, "instante": "ayer", "valor": 2}', '{"indicador_id": 1, "instante": "2025-03-11T10:00:00", "valor": 2}', '{"indicador_id": 1, "instante": "2025-03-11T10:00:00Z", "valor": null}', ""]
    frame = spark.createDataFrame([(b.encode(),) for b in [*bad, message("2025-03-11T10:00:00Z", 5)]] + [(b"\xff\xfe{}",), (None,)], "value binary")
    readings, rejects = gates.split(frame, F.lit(HOUR).cast("timestamp"))
    assert readings.collect()[0]["valor"] == 5.0 and readings.count() == 1
    why = {r["original"]: r["motivo"] for r in rejects.collect()}
    assert len(why) >= len(bad) and why["{no"].startswith("JSONDecodeError") and why["[1, 2]"].startswith("TypeError")
    assert why[bad[2]] == "ValueError: faltan campos: instante" and rejects.count() == len(bad) + 2


def test_messages_round_trip(spark):
    readings = spark.createDataFrame([(77, HOUR, 2.5)], "indicador_id bigint, instante timestamp, valor double")
    again, rejects = gates.split(gates.to_messages(readings), F.current_timestamp())
    assert again.collect() == readings.collect() and rejects.count() == 0


def test_tolerance_is_that_of_the_batch():
    assert panes.TOLERANCE_MS == 48 * panes.HOUR_MS


def test_requests_are_bounded_and_carry_every_row(spark, tmp_path):
    sink = str(tmp_path / "sent")

    def send(messages):
        import os
        import pickle
        import uuid

        os.makedirs(sink, exist_ok=True)
        with open(f"{sink}/{uuid.uuid4().hex}", "wb") as f:
            pickle.dump(messages, f)

    rows = spark.range(0, 1203, 1, 2).selectExpr("timestamp_seconds(id) AS hora", "id AS indicador_id", "id / 2 AS potencia_media_mw", "0D AS potencia_min_mw", "1D AS potencia_max_mw", "0L AS lecturas", "false AS hora_completa", "0L AS panel", "id % 2 = 0 AS es_tardio", "timestamp_seconds(id) AS emitido_en")
    flow.batched(rows, schemas.PANES, send)
    import pickle

    requests = [pickle.loads(p.read_bytes()) for p in (tmp_path / "sent").iterdir()]
    assert sum(map(len, requests)) == 1203 and max(map(len, requests)) <= 500
    first = next(m for r in requests for m in r if read_wire(m)[2] == 5)
    assert read_wire(first) == {1: 5_000_000, 2: 5, 3: 2.5, 4: 0.0, 5: 1.0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 5_000_000}


def read_wire(message):
    """Fields of a message in the protocol-buffer wire format."""
    import struct

    def varint(at):
        n = shift = 0
        while True:
            b = message[at]
            n |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return n, at

    fields, at = {}, 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            fields[tag >> 3], at = varint(at)
        elif tag & 7 == 1:
            fields[tag >> 3], at = struct.unpack("<d", message[at : at + 8])[0], at + 8
        else:
            n, at = varint(at)
            fields[tag >> 3], at = message[at : at + n].decode(), at + n
    return fields


def test_wire_leaves_nulls_out_and_writes_text():
    kinds = [("a", "STRING"), ("b", "INTEGER"), ("c", "FLOAT")]
    assert read_wire(schemas.wire(kinds, ("ñandú", None, -1.5))) == {1: "ñandú", 3: -1.5}
    assert read_wire(schemas.wire(kinds, (None, -1, None))) == {2: (1 << 64) - 1}
