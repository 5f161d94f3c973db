import json
import random

import pytest

from tidewell.operators import ask, lineage, register, sqlrefs, usage
from tidewell.plans import registry, render
from tidewell.sources import metadata

CHAIN = [("p.raw.m", "p.stg.m"), ("p.stg.m", "p.stg.h"), ("p.stg.h", "p.mart.a"), ("p.stg.h", "p.mart.b")]


def graph(spark, edges, extra=()):
    ids = sorted({n for e in edges for n in e} | set(extra))
    nodes = spark.createDataFrame([(i, "modelo", "", "") for i in ids], "id string, tipo string, capa string, detalle string")
    return lineage.Graph.of([nodes], [spark.createDataFrame([(a, b, "sql") for a, b in edges], "origen string, destino string, motivo string")])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reach_both_ways(spark):
    g = graph(spark, CHAIN)
    assert rows(g.impact("p.raw.m")) == [("p.stg.m", 1, "p.raw.m"), ("p.stg.h", 2, "p.stg.m"), ("p.mart.a", 3, "p.stg.h"), ("p.mart.b", 3, "p.stg.h")]
    assert [r[0] for r in rows(g.ancestry("p.mart.a"))] == ["p.stg.h", "p.stg.m", "p.raw.m"]
    assert [r[0] for r in rows(g.impact("p.raw.m", 1))] == ["p.stg.m"]
    assert rows(g.impact("p.mart.a")) == []
    with pytest.raises(lineage.UnknownNode):
        g.impact("p.none")


def test_orphans_roots_resolve(spark):
    g = graph(spark, CHAIN, ["p.alone"])
    assert [r[0] for r in rows(g.orphans())] == ["p.alone", "p.mart.a", "p.mart.b"]
    assert [r[0] for r in rows(g.roots())] == ["p.alone", "p.raw.m"]
    assert g.resolve("mart.a") == "p.mart.a"
    with pytest.raises(lineage.AmbiguousNode):
        g.resolve("m")


def test_an_exact_id_is_never_ambiguous(spark):
    nodes = spark.createDataFrame([(f"a{i:03}.orders", "tabla", "", "") for i in range(60)] + [("orders", "tabla", "", "")], "id string, tipo string, capa string, detalle string")
    g = lineage.Graph.of([nodes], [spark.createDataFrame([("orders", "a001.orders", "sql")], "origen string, destino string, motivo string")])
    assert g.resolve("Orders") == "orders" and g.resolve("a007.orders") == "a007.orders"
    with pytest.raises(lineage.AmbiguousNode) as e:
        lineage.Graph(g.nodes.where("id <> 'orders'"), g.edges).resolve("orders")
    assert len(e.value.candidates) == 50


def test_a_cycle_is_seen_when_a_round_peels_nothing(spark, monkeypatch):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(3)] + [(f"m{i:02}", f"m{(i + 1) % 3:02}") for i in range(3)]
    ids = sorted({n for e in edges for n in e} | {f"z{i}" for i in range(25)})
    cuts = []
    monkeypatch.setattr(lineage, "durable", lambda df, real=lineage.durable: cuts.append(1) or real(df))
    got = dict(rows(lineage.longest_levels(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "origen string, destino string"), small=0)))
    assert got == lineage.cut_levels(ids, edges) and len(cuts) < 20


def test_both_ways_of_walking_agree(spark):
    rnd = random.Random(7)
    for size, chance in ((8, 0.2), (12, 0.12)):
        edges = [(f"n{a}", f"n{b}") for a in range(size) for b in range(size) if rnd.random() < chance]
        frame = spark.createDataFrame(edges, "origen string, destino string")
        pairs = frame.selectExpr("origen AS a", "destino AS b")
        for hops in (None, 2):
            assert rows(lineage.reach(pairs, "n0", hops)) == rows(lineage.reach(pairs, "n0", hops, small=0))
        assert rows(lineage.strongly_connected(frame)) == sorted(rows(lineage.strongly_connected(frame, small=0)))
    ids = [f"n{i}" for i in range(9)]
    dag = [(a, b) for a in ids for b in ids if a < b and rnd.random() < 0.3]
    frames = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(dag, "origen string, destino string")
    assert rows(lineage.longest_levels(*frames)) == sorted(rows(lineage.longest_levels(*frames, small=0)))


def test_back_edges_and_members_differ_as_documented(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "a"), ("c", "b")]
    assert lineage.back_edge_paths(["a", "b", "c"], edges) == [["a", "b", "a"]]
    frame = spark.createDataFrame(edges, "origen string, destino string")
    assert sorted(r[0] for r in rows(lineage.strongly_connected(frame))) == ["a", "b", "c"]


def test_levels_take_the_longest_path():
    edges = [("raw", "stg"), ("stg", "mart"), ("raw", "mart")]
    assert lineage.cut_levels(["raw", "stg", "mart"], edges) == {"raw": 0, "stg": 1, "mart": 2}
    assert set(lineage.cut_levels(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])) == {"a", "b", "c"}


def test_levels_of_frames_equal_the_walk(spark):
    random.seed(3)
    edges = [(f"n{a:02}", f"n{b:02}") for a in range(12) for b in range(a + 1, 12) if random.random() < 0.25]
    ids = [f"n{i:02}" for i in range(12)]
    got = dict(rows(lineage.longest_levels(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "origen string, destino string"))))
    assert got == lineage.cut_levels(ids, edges)


def test_layout_has_no_overlap():
    edges = [(a.replace("p.", ""), b.replace("p.", "")) for a, b in CHAIN]
    placed = lineage.layout(sorted({n for e in edges for n in e}), edges)
    assert len({(x, y) for *_, x, y in placed}) == len(placed)
    assert lineage.layout([], []) == []


def test_known_type_replaces_unknown_once(spark):
    kind = "id string, tipo string, capa string, detalle string"
    a = spark.createDataFrame([("X", "externo", None, "seen"), ("y", "modelo", "m", "")], kind)
    b = spark.createDataFrame([("x", "modelo", "marts", None), ("y", "vista", "v", "late")], kind)
    got = {r["id"]: (r["tipo"], r["capa"], r["detalle"]) for r in lineage.merged_nodes(a, b).collect()}
    assert got == {"x": ("modelo", "marts", "seen"), "y": ("modelo", "m", "late")}


def test_parser_and_pattern(spark):
    read = lambda s: sqlrefs.read(spark, s)
    assert read("SELECT * FROM `p.d.t` WHERE k IN (SELECT k FROM p.d.u)").references == {"p.d.t", "p.d.u"}
    assert read("WITH c AS (SELECT * FROM a.b) SELECT * FROM c").references == {"a.b"}
    assert read("select 1 -- from p.old.t").commented == {"p.old.t"}
    broken = read("SELECT FROM FROM p.d.t WHERE ((")
    assert broken.approximate and broken.error and "p.d.t" in broken.references
    assert read("  ").references == set() and read(None).references == set()
    assert read("CALL p.ops.go(1)").references == {"p.ops.go"}


def test_verdicts_need_a_history(spark):
    orphans = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    used = spark.createDataFrame([("b", 3, 0, ["x.gserviceaccount.com"]), ("c", 2, 1, ["me@x.com"])], "tabla string, consultas bigint, consultas_de_personas bigint, quienes array<string>")
    assert [(r["tabla"], r["veredicto"], r["borrable"]) for r in usage.verdicts(orphans, used).collect()] == [("a", "sin lecturas", True), ("b", "solo la tuberia", False), ("c", "la usan personas", False)]
    assert not any(r["borrable"] for r in usage.verdicts(orphans, None).collect())


def test_questions_and_evaluation(spark):
    g = graph(spark, CHAIN)
    assert ask.ask(spark, g, "¿Qué se rompe si toco stg.h?").tables == {"p.mart.a", "p.mart.b"}
    assert ask.ask(spark, g, "¿qué se rompe si toco la tabla de pedidos?").error
    assert ask.ask(spark, g, "de dónde sale `p.stg.m`").tables == {"p.raw.m"}
    bank = [{"pregunta": "¿Hay algún ciclo?", "operacion": "ciclos"}, {"pregunta": "impacto de raw.m a un salto", "operacion": "impacto", "esperadas": ["stg.m"]}, {"pregunta": "¿qué puedo borrar?", "operacion": "huerfanas", "esperadas": ["mart.a", "mart.b"]}]
    report = ask.report(ask.evaluate(spark, g, bank, "p")).first()
    assert (report["casos"], report["exactas"], report["operaciones"], report["f2"]) == (3, 3, 3, 1.0)


def test_snapshot_round_trip_and_viewer(spark, tmp_path):
    g = graph(spark, CHAIN)
    path = tmp_path / "graph.json"
    path.write_text(metadata.snapshot(g))
    again = metadata.read_snapshot(spark, str(path))
    assert metadata.snapshot(again) == metadata.snapshot(g)
    assert len(json.loads(path.read_text())["aristas"]) == 4
    nodes = spark.createDataFrame([("a.b", "modelo", "", "</script><b>")], "id string, tipo string, capa string, detalle string")
    page = render.viewer(lineage.Graph.of([nodes], [g.edges.selectExpr("origen", "destino", "'x' AS motivo")]))
    assert page.count("</script>") == 2
    assert "->" in render.plan_dot(g.edges)


def test_causal_cycles_never_leave_links_out(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a")]
    frame = spark.createDataFrame([(i, [("causada_por", j)]) for i, j in rows], "id string, enlaces array<struct<tipo:string,destino:string>>")
    assert len(register.causal_cycles(frame, limit=3)) == 1
    with pytest.raises(ValueError):
        register.causal_cycles(frame, limit=2)


def test_register_checks_reads_every_order(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    n = spark.read.parquet(f"{path}/orders.parquet").where("o_orderkey % 2 = 0").count()
    got = {r["control"]: r["filas"] for r in registry.QUERIES["register_checks"](spark, path).collect()}
    assert n > 1501 and got["publicas"] == n
