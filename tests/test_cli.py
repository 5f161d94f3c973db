import json

import pytest

from tidewell import cli, session
from tidewell.sources import metadata

from test_lineage import CHAIN, graph


@pytest.fixture()
def snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "build", lambda *a, **b: spark)
    path = tmp_path / "g.json"
    path.write_text(metadata.snapshot(graph(spark, CHAIN)))
    return str(path)


def test_lineage_verbs(snapshot, capsys, tmp_path):
    assert cli.main(["impacto", "raw.m", "--grafo", snapshot, "--saltos", "2"]) == 0
    assert capsys.readouterr().out.split() == ["p.stg.m", "p.stg.h"]
    assert cli.main(["linaje", "m", "--grafo", snapshot]) == 7 and cli.main(["linaje", "none", "--grafo", snapshot]) == 6
    assert cli.main(["ciclos", "--grafo", snapshot]) == 0 and cli.main(["grafo", "--grafo", snapshot]) == 0
    assert cli.main(["visor", "--grafo", snapshot, "--salida", str(tmp_path / "v.html")]) == 0 and (tmp_path / "v.html").read_text().startswith("<!DOCTYPE")
    assert cli.main(["huerfanas", "--grafo", snapshot]) == 0 and "historial no disponible" in capsys.readouterr().out
    assert cli.main(["pregunta", "¿de dónde sale?", "--grafo", snapshot]) == 1
    assert cli.main(["ciclos"]) == 3
    bank = tmp_path / "bank.yaml"
    bank.write_text('casos:\n  - pregunta: "impacto de stg.h"\n    operacion: impacto\n    esperadas: [mart.a, mart.b]\n')
    assert cli.main(["evaluar", "--banco", str(bank), "--proyecto", "p", "--grafo", snapshot, "--minimo-f2", "0.95"]) == 0


def test_plan_publish_and_search(snapshot, capsys, tmp_path):
    assert cli.main(["plan", "--indicador", "551", "--desde", "2026-09-01", "--ahora", "2026-09-10", "--dias", "3"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    lines = tmp_path / "m.jsonl"
    lines.write_text('{"a": 1}\n\nnot json\n')
    assert cli.main(["publicar", "--fichero", str(lines), "--tema", str(tmp_path / "topic")]) == 0
    catalog = tmp_path / "c.json"
    catalog.write_text(json.dumps([{"id": 1, "name": "Eólica"}]))
    assert cli.main(["buscar", "eolica", "--catalogo", str(catalog)]) == 0 and cli.main(["buscar", "nada", "--catalogo", str(catalog)]) == 1


def test_ingest_then_reconcile(spark, snapshot, capsys, tmp_path, monkeypatch):
    """Readings from a local server, stored, published, streamed and compared."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            values = [{"value": 100.0 + i, "datetime_utc": f"2026-09-01T00:{5 * i:02}:00Z", "geo_id": 1, "geo_name": "z"} for i in range(12)]
            body = json.dumps({"indicator": {"id": 551, "name": "x", "values": values}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = lambda n: str(tmp_path / n)
    args = ["--indicador", "551", "--desde", "2026-09-01", "--ahora", "2026-09-02", "--marcas", at("marks")]
    assert cli.main(["ingesta", *args, "--url", f"http://127.0.0.1:{server.server_port}", "--datos", at("raw"), "--auditoria", at("audit"), "--publicar", at("topic")]) == 0
    server.shutdown()
    assert spark.read.parquet(at("raw")).count() == 12 and spark.read.parquet(at("audit")).first()["puntos"] == 12
    from tidewell.streaming import flow

    for i in range(3):
        (tmp_path / "topic" / f"end{i}.txt").write_text('{"indicador_id": -1, "instante": "2027-01-01T00:00:00Z", "valor": 0}\n')
        assert flow.run(flow.messages(spark, at("topic")), at("out"), at("state"), available_now=True)
    assert cli.main(["cuadrar", "--indicador", "551", "--datos", at("raw"), "--flujo", at("out/panes")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["horas"] == 1


def serve(answer):
    """A local server; answer(path, nth request for it) gives (code, body) or None to hang up."""
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = Counter()

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            found = answer(self.path, asked[self.path])
            if found is None:
                self.connection.close()
                return
            self.send_response(found[0])
            self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(found[1].encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, asked


def body(day, hourly=False):
    values = [{"value": 12.0 * 105.5 if hourly else 100.0 + i, "datetime_utc": f"{day}T00:{5 * i:02}:00Z", "geo_id": 1, "geo_name": "z"} for i in range(1 if hourly else 12)]
    return json.dumps({"indicator": {"id": 551, "name": "x", "values": values}})


def test_a_mark_never_passes_a_failed_window(spark, snapshot, tmp_path):
    def answer(path, nth):
        day = path.split("start_date=")[1][:10]
        if day == "2026-09-04":
            return 404, "gone"
        if day == "2026-09-07" and nth == 1:
            return 503, ""
        return 200, body(day)

    server, asked = serve(answer)
    at = lambda n: str(tmp_path / n)
    args = ["--indicador", "551", "--desde", "2026-09-01", "--ahora", "2026-09-10", "--dias", "3", "--marcas", at("marks"), "--url", f"http://127.0.0.1:{server.server_port}", "--datos", at("raw"), "--auditoria", at("audit")]
    assert cli.main(["ingesta", *args]) == 4
    server.shutdown()
    from tidewell.sources import store

    assert [str(r["hasta"])[:10] for r in store.Watermarks(spark, at("marks")).load().collect()] == ["2026-09-04"]
    assert spark.read.parquet(at("raw")).count() == 24
    audit = {str(r["ventana_inicio"])[:10]: (r["codigo"], r["intentos"], r["error"]) for r in spark.read.parquet(at("audit")).collect()}
    assert audit == {"2026-09-01": (200, 1, None), "2026-09-04": (404, 1, "HTTP 404"), "2026-09-07": (200, 2, None)}
    assert sum(asked.values()) == 4


def test_dead_connections_and_unreadable_answers_are_audited(spark, snapshot, tmp_path):
    server, asked = serve(lambda path, nth: None if "2026-09-01" in path.split("end_date")[0] else (200, "<html>"))
    at = lambda n: str(tmp_path / n)
    args = ["--indicador", "551", "--desde", "2026-09-01", "--ahora", "2026-09-07", "--dias", "3", "--max-peticiones", "3", "--marcas", at("marks"), "--url", f"http://127.0.0.1:{server.server_port}", "--datos", at("raw"), "--auditoria", at("audit")]
    assert cli.main(["ingesta", *args]) == 4
    server.shutdown()
    rows = sorted((str(r["ventana_inicio"])[:10], r["codigo"], r["intentos"]) for r in spark.read.parquet(at("audit")).collect())
    assert rows == [("2026-09-01", None, 2), ("2026-09-04", 200, 1)]  # three requests in all: one window may be asked for twice
    assert sum(asked.values()) == 3


def test_diagnosis_says_whether_hours_are_sums(snapshot, capsys):
    server, asked = serve(lambda path, nth: (200, body("2026-09-01", "time_trunc=hour" in path)))
    assert cli.main(["diagnostico", "551", "--dia", "2026-09-01", "--url", f"http://127.0.0.1:{server.server_port}"]) == 0
    server.shutdown()
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x.get("puntos") for x in lines[:2]] == [12, 1] and lines[2]["veredicto"] == "SUM" and lines[2]["media"] == 105.5
    assert sum(asked.values()) == 2 and cli.main(["diagnostico", "551", "--dia", "2026-09-01"]) == 3


REGISTER = """
proyecto: {nombre: prueba}
vocabulario: {carriles: [datos, red], hitos: [{id: h1, pregunta: uno}, {id: h2, pregunta: dos}]}
decisiones:
  - {id: d2, titulo: segunda, fecha: 2025-02-02, orden: 1, carril: red, publica: false, causada_por: d1, supera_a: [d1]}
  - {id: d1, titulo: primera, fecha: 2025-02-01, orden: 1, carril: datos, hito: h1, superada_por: d2, alternativas: [{elegida: true, motivo: a}, {elegida: false, motivo: b}]}
"""


def test_register_is_checked_and_written(snapshot, tmp_path, capsys):
    path, out = tmp_path / "r.yaml", tmp_path / "r.js"
    path.write_text(REGISTER)
    assert cli.main(["registro", "--fichero", str(path), "--salida", str(out)]) == 0
    read = lambda: json.loads(out.read_text().split(" = ", 1)[1].rstrip(";\n"))
    assert [d["id"] for d in read()["decisiones"]] == ["d1", "d2"] and [h["id"] for h in read()["preguntas_abiertas"]] == ["h2"]
    assert cli.main(["registro", "--fichero", str(path), "--salida", str(out), "--publico"]) == 0
    assert [(d["id"], d["enlaces"]) for d in read()["decisiones"]] == [("d1", [])]
    for bad in (REGISTER.replace("carril: red", "carril: azul"), REGISTER.replace("superada_por: d2,", ""), REGISTER.replace("causada_por: d1", "causada_por: d9"), REGISTER.replace("elegida: false", "elegida: true"), "- a", "a: [b"):
        path.write_text(bad)
        assert cli.main(["registro", "--fichero", str(path), "--salida", str(out)]) == 3
