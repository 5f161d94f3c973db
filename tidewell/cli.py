"""Command line: ``python -m tidewell.cli COMMAND``. Exit codes: 0 done, 1 nothing found or a check failed, 2 usage, 3 bad input, 4 request failed, 6 no such table, 7 ambiguous table."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schemas, session
from tidewell.operators import ask, lineage, planner, register, series, usage
from tidewell.plans import render
from tidewell.sources import api, metadata, store
from tidewell.streaming import flow, gates


def when(text: str) -> datetime:
    """An instant; without a zone, UTC."""
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        one = sub.add_parser(name)
        for names, options in arguments:
            one.add_argument(*names, **options)

    def a(*names: str, **options) -> tuple:
        return names, options

    policy = (a("--indicador", type=int, action="append", required=True), a("--desde", type=when, required=True), a("--ahora", type=when), a("--revisable", type=int, default=48), a("--dias", type=int, default=7), a("--max-peticiones", type=int, default=50), a("--marcas"))
    graph = (a("--grafo"), a("--manifiesto"))
    add("buscar", a("texto"), a("--catalogo", required=True))
    add("plan", *policy)
    add("ingesta", *policy, a("--url", required=True), a("--token"), a("--catalogo"), a("--datos", required=True), a("--auditoria", required=True), a("--publicar"))
    add("diagnostico", a("indicador", type=int), a("--datos"), a("--horario"), a("--url"), a("--token"), a("--dia", type=when, required=True))
    for name in ("linaje", "impacto"):
        add(name, a("tabla"), a("--saltos", type=int), *graph)
    add("huerfanas", *graph, a("--externas", action="store_true"), a("--historial"), a("--dias", type=int, default=180))
    add("ciclos", *graph)
    add("grafo", *graph, a("--salida"))
    add("visor", *graph, a("--salida", required=True))
    add("pregunta", a("texto"), a("--explicar", action="store_true"), *graph)
    add("evaluar", a("--banco", required=True), a("--proyecto", default=""), a("--minimo-f2", type=float, default=0.0), *graph)
    kafka = a("--kafka", help="servers; the folder's argument then names the topic")
    add("flujo", kafka, a("--entrada", required=True), a("--salida", required=True), a("--estado", required=True), a("--segundos", type=float))
    add("publicar", kafka, a("--fichero", required=True), a("--tema", required=True))
    add("registro", a("--fichero", required=True), a("--salida", required=True), a("--publico", action="store_true"))
    add("cuadrar", a("--indicador", type=int, required=True), a("--datos", required=True), a("--flujo", required=True), a("--tolerancia", type=float, default=0.001))
    return p


def show(rows: DataFrame) -> int:
    """Prints rows as JSON lines; 1 if there are none."""
    n = 0
    for row in rows.toJSON().toLocalIterator():
        print(row)
        n += 1
    return int(not n)


def read_graph(spark: SparkSession, args: argparse.Namespace) -> lineage.Graph:
    if args.grafo:
        graph = metadata.read_snapshot(spark, args.grafo)
        if not args.manifiesto:
            return graph
        nodes, edges = metadata.read_manifest(spark, args.manifiesto)
        old = graph.edges.select("origen", "destino", F.array_join("fuentes", "+").alias("motivo"))
        return lineage.Graph.of([graph.nodes, nodes], [old, edges])
    if args.manifiesto:
        nodes, edges = metadata.read_manifest(spark, args.manifiesto)
        return lineage.Graph.of([nodes], [edges])
    raise ValueError("--grafo or --manifiesto is needed")


def planned(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    policy = planner.Policy(args.desde, args.revisable, args.dias, args.max_peticiones)
    asked = spark.createDataFrame(list(zip(args.indicador, range(len(args.indicador)), strict=True)), "indicador_id bigint, pos int")
    marks = store.Watermarks(spark, args.marcas).load() if args.marcas else spark.createDataFrame([], "indicador_id bigint, hasta timestamp")
    return planner.plan(asked, marks, args.ahora or datetime.now(timezone.utc), policy)


def fetched_windows(spark: SparkSession, url: str, token: str | None, windows: list[list], most: int, trunc: str | None = None) -> DataFrame:
    """What the API answers for windows [indicator, start, end], kept so that nothing is asked twice."""
    spark.dataSource.register(api.ReadingsApi)
    reader = spark.read.format("readings_api").option("url", url).option("windows", json.dumps(windows)).option("max_requests", str(most))
    for name, value in (("token", token), ("time_trunc", trunc)):
        reader = reader.option(name, value) if value else reader
    return lineage.durable(reader.load())


def unbroken(fetched: DataFrame) -> DataFrame:
    """(indicador_id, hasta): the end of each indicator's windows before its first one that failed, so that a mark never passes a hole."""
    bad = fetched.where("codigo IS NULL OR codigo <> 200").groupBy("indicador_id").agg(F.min("inicio").alias("roto"))
    good = fetched.where("codigo = 200").join(bad, "indicador_id", "left").where("roto IS NULL OR inicio < roto")
    return good.groupBy("indicador_id").agg(F.max("fin").alias("hasta"))


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    """Fetch, append, publish, advance, audit, in this order: a mark moves only after its readings, and all before them, are stored."""
    if args.catalogo:
        missing = metadata.Catalog.load(spark, args.catalogo).missing(spark.createDataFrame([(i,) for i in args.indicador], "id bigint"))
        if not missing.isEmpty():
            raise ValueError(f"not in the catalog: {', '.join(str(r['id']) for r in missing.collect())}")
    windows = [[r["indicador_id"], r["inicio"].replace(tzinfo=timezone.utc).isoformat(), r["fin"].replace(tzinfo=timezone.utc).isoformat()] for r in planned(spark, args).collect()]
    if not windows:
        return 0
    fetched = fetched_windows(spark, args.url, args.token, windows, args.max_peticiones)
    good = fetched.where("codigo = 200")
    store.append_readings(api.readings(good), args.datos, F.current_timestamp())
    if args.publicar:
        gates.to_messages(api.readings(good)).write.mode("append").text(args.publicar)
    if args.marcas:
        store.Watermarks(spark, args.marcas).advance(unbroken(fetched), F.current_timestamp())
    store.append_requests(api.audit(fetched, F.current_timestamp()), args.auditoria)
    return 4 if fetched.where("codigo IS NULL OR codigo <> 200").count() else 0


def diagnose(spark: SparkSession, args: argparse.Namespace) -> int:
    """Zones of a day's fine and hourly readings, from the API (two windows, four requests at most) or from stored folders; then whether the first hour is the sum or the mean."""
    day = args.dia
    if args.url:
        window = [[args.indicador, day.isoformat(), (day + timedelta(days=1)).isoformat()]]
        fine, hourly = (api.readings(fetched_windows(spark, args.url, args.token, window, 2, trunc).where("codigo = 200")) for trunc in (None, "hour"))
    elif args.datos:
        own = lambda path: store.load(spark, path, schemas.READINGS).where((F.col("indicador_id") == args.indicador) & (F.to_date("instante") == F.lit(day.date())))
        fine, hourly = own(args.datos), own(args.horario) if args.horario else None
    else:
        raise ValueError("--url or --datos is needed")
    nothing = show(series.by_zone(fine))
    first = None if hourly is None or show(series.by_zone(hourly)) else hourly.orderBy("instante", F.asc_nulls_last("geo_id")).first()
    if first is not None:
        zone = F.col("geo_id").eqNullSafe(F.lit(first["geo_id"]))
        coarse = hourly.where(zone & (F.col("instante") == F.lit(first["instante"]))).select("indicador_id", F.col("instante").alias("hora"), "valor")
        show(series.sum_or_mean(fine.where(zone), coarse))
    return nothing


def run(args: argparse.Namespace) -> int:
    spark = session.build("tidewell")
    command = args.command
    if command == "buscar":
        return show(metadata.Catalog.load(spark, args.catalogo).search(args.texto))
    if command == "plan":
        return show(planned(spark, args))
    if command == "ingesta":
        return ingest(spark, args)
    if command == "diagnostico":
        return diagnose(spark, args)
    if command == "flujo":
        kafka = {"kafka.bootstrap.servers": args.kafka, "subscribe": args.entrada, "startingOffsets": "earliest"} if args.kafka else None
        return int(not flow.run(flow.messages(spark, args.entrada, kafka), args.salida, args.estado, args.segundos))
    if command == "publicar":
        lines = store.raw_lines(spark, args.fichero)
        if args.kafka:
            flow.to_kafka(lines, {"kafka.bootstrap.servers": args.kafka, "topic": args.tema})
        else:
            lines.write.mode("append").text(args.tema)
        return 0
    if command == "registro":
        Path(args.salida).write_text(register.script(spark, register.read_register(args.fichero), only_public=args.publico), encoding="utf-8")
        return 0
    if command == "cuadrar":
        raw = store.load(spark, args.datos, schemas.READINGS).where(F.col("indicador_id") == args.indicador)
        none = spark.createDataFrame([], schemas.TECHNOLOGIES.schema)
        panes = series.current_panes(spark.read.schema(schemas.PANES.schema).parquet(args.flujo).where(F.col("indicador_id") == args.indicador))
        row = series.reconcile(series.hourly(series.staged_readings(raw), none), panes, args.tolerancia).first()
        print(json.dumps(row.asDict()))
        return int(not row["horas"] or row["medias_mal"] > 0 or row["conteos_mal"] > 0)

    graph = read_graph(spark, args)
    if command in ("linaje", "impacto"):
        node = graph.resolve(args.tabla)
        for r in (graph.ancestry if command == "linaje" else graph.impact)(node, args.saltos).collect():
            print("  " * r["salto"] + r["id"])
    elif command == "huerfanas":
        reads = usage.reads(spark.read.parquet(args.historial), F.current_timestamp(), args.dias) if args.historial else None
        return show(usage.verdicts(graph.orphans(args.externas), reads))
    elif command == "ciclos":
        paths = graph.cycles()
        print("\n".join(" -> ".join(p) for p in paths) or "sin ciclos")
        return int(bool(paths))
    elif command == "grafo":
        if not args.salida:
            show(graph.summary())
            return show(graph.listing())
        Path(args.salida).write_text(metadata.snapshot(graph), encoding="utf-8")
    elif command == "visor":
        Path(args.salida).write_text(render.viewer(graph), encoding="utf-8")
    elif command == "pregunta":
        if args.explicar:
            show(ask.interpret(spark.createDataFrame([(args.texto,)], "pregunta string")))
        found = ask.ask(spark, graph, args.texto)
        print(found.error or found.text)
        return int(found.error is not None)
    elif command == "evaluar":
        scored = ask.evaluate(spark, graph, ask.load_bank(args.banco), args.proyecto)
        row = ask.report(scored).first()
        print(json.dumps(row.asDict()))
        show(ask.failures(scored))
        return int(row["f2"] < args.minimo_f2)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except lineage.AmbiguousNode as e:
        code, why = 7, e
    except lineage.UnknownNode as e:
        code, why = 6, e
    except (api.RequestFailed, api.BudgetSpent) as e:
        code, why = 4, e
    except (ValueError, OSError) as e:
        code, why = 3, e
    print(why, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
