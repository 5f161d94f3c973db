"""What the lineage graph is built from: indicator catalogs, warehouse catalogs, manifests and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import completed_name, folded
from tidewell.operators.lineage import Graph
from tidewell.operators.sqlrefs import references

# Kinds of table and of manifest resource, and the node types they become.
TABLE_TYPES = {"BASE TABLE": "tabla", "VIEW": "vista", "MATERIALIZED VIEW": "vista", "EXTERNAL": "externo"}
RESOURCE_TYPES = {"model": "modelo", "seed": "semilla", "source": "fuente", "test": "prueba", "snapshot": "modelo"}


class Catalog:
    """A5: the indicators there are. Frames have (id, nombre)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    @staticmethod
    def load(spark: SparkSession, path: str) -> Catalog:
        """A bare JSON list of {id, name}, or an object with ``indicadores``; an empty catalog is an error."""
        text = spark.read.text(path, wholetext=True)
        item = "ARRAY<STRUCT<id: BIGINT, name: STRING, nombre: STRING>>"
        body = F.col("value")
        listed = F.coalesce(F.from_json(body, f"indicadores {item}")["indicadores"], F.from_json(body, item))
        rows = text.select(F.explode(listed).alias("x")).select("x.id", F.coalesce("x.nombre", "x.name").alias("nombre")).where("id IS NOT NULL")
        if rows.isEmpty():
            raise ValueError(f"{path} has no indicators")
        return Catalog(rows)

    def missing(self, ids: DataFrame) -> DataFrame:
        """Every id that the catalog hasn't."""
        return ids.select("id").distinct().join(self.rows.select("id"), "id", "left_anti").orderBy("id")

    def search(self, text: str, n: int = 40) -> DataFrame:
        """the first n indicators by id whose name has the text, accents and case aside."""
        return self.rows.where(folded(F.col("nombre")).contains(folded(F.lit(text)))).orderBy("id").limit(n)


def _mapped(column: Column, table: dict[str, str], default: str = "desconocido") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), F.lit(default))


def from_catalog(tables: DataFrame, views: DataFrame, routines: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a warehouse's catalog frames: TABLES, VIEWS with their SQL, ROUTINES with their DDL."""
    name = lambda s, t: F.lower(F.concat_ws(".", F.lit(project), s, t))
    table_nodes = tables.select(name("table_schema", "table_name").alias("id"), _mapped(F.col("table_type"), TABLE_TYPES).alias("tipo"), F.col("table_schema").alias("capa"), F.lit("").alias("detalle"))
    routine_nodes = routines.select(name("routine_schema", "routine_name").alias("id"), F.lit("desconocido").alias("tipo"), F.col("routine_schema").alias("capa"), F.lower("routine_type").alias("detalle"))
    definitions = views.select("table_schema", name("table_schema", "table_name").alias("destino"), F.col("view_definition").alias("sql")).unionByName(
        routines.select(F.col("routine_schema").alias("table_schema"), name("routine_schema", "routine_name").alias("destino"), F.col("ddl").alias("sql")))
    edges = definitions.select("destino", "table_schema", F.explode(references(F.col("sql"))).alias("r")).select(completed_name(F.col("r"), F.lit(project), F.col("table_schema")).alias("origen"), "destino", F.lit("catalogo").alias("motivo"))
    return table_nodes.unionByName(routine_nodes), edges.where("origen <> destino")


def session_catalog(spark: SparkSession, databases: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(TABLES, VIEWS, warnings) of the session's own catalog; a database that can't be read is a warning."""
    tables, views, warnings = [], [], []
    for db in databases:
        try:
            for t in spark.catalog.listTables(db):
                kind = "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE"
                tables.append((db, t.name, kind))
                if t.tableType == "VIEW":
                    text = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{db}`.`{t.name}`").collect() if r["col_name"] == "View Text"]
                    views.append((db, t.name, text[0] if text else ""))
        except Exception as e:  # noqa: BLE001  the rest of the catalog still counts
            warnings.append(f"{db}: {str(e).splitlines()[0]}")
    return spark.createDataFrame(tables, "table_schema string, table_name string, table_type string"), spark.createDataFrame(views, "table_schema string, table_name string, view_definition string"), warnings


def from_manifest(manifest: DataFrame, with_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of manifest texts in ``value``. Edges come from parent_map; tests are left out unless asked for."""
    entry = "STRUCT<resource_type: STRING, database: STRING, schema: STRING, identifier: STRING, alias: STRING, name: STRING, description: STRING, path: STRING, original_file_path: STRING>"
    parsed = manifest.select(F.from_json("value", f"nodes MAP<STRING, {entry}>, sources MAP<STRING, {entry}>, parent_map MAP<STRING, ARRAY<STRING>>").alias("m"))
    both = parsed.select(F.explode(F.coalesce("m.nodes", F.create_map().cast(f"MAP<STRING, {entry}>"))).alias("key", "n")).unionByName(parsed.select(F.explode(F.coalesce("m.sources", F.create_map().cast(f"MAP<STRING, {entry}>"))).alias("key", "n")))
    if not with_tests:
        both = both.where("n.resource_type <> 'test'")
    path = F.split(F.coalesce("n.path", "n.original_file_path", F.lit("")), "/")
    folder = F.when(F.size(path) > 1, F.get(path, F.size(path) - 2))
    named = both.select("key", F.lower(F.concat_ws(".", "n.database", "n.schema", F.coalesce("n.identifier", "n.alias", "n.name"))).alias("id"), _mapped(F.col("n.resource_type"), RESOURCE_TYPES).alias("tipo"), folder.alias("capa"), F.coalesce("n.description", F.lit("")).alias("detalle"))
    pairs = parsed.select(F.explode("m.parent_map").alias("child", "parents")).select("child", F.explode("parents").alias("parent"))
    edges = pairs.join(named.select(F.col("key").alias("parent"), F.col("id").alias("origen")), "parent").join(named.select(F.col("key").alias("child"), F.col("id").alias("destino")), "child")
    return named.drop("key"), edges.select("origen", "destino", F.lit("manifiesto").alias("motivo"))


def read_manifest(spark: SparkSession, path: str, with_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    return from_manifest(spark.read.text(path, wholetext=True), with_tests)


def read_snapshot(spark: SparkSession, path: str) -> Graph:
    """A graph from its JSON snapshot {nodos, aristas}."""
    schema = "nodos ARRAY<STRUCT<id: STRING, tipo: STRING, capa: STRING, detalle: STRING>>, aristas ARRAY<STRUCT<origen: STRING, destino: STRING, motivo: STRING>>"
    body = spark.read.schema(schema).json(path, multiLine=True)
    return Graph.of([body.select(F.explode("nodos").alias("n")).select("n.*")], [body.select(F.explode("aristas").alias("a")).select("a.*")])


def snapshot(graph: Graph) -> str:
    """The graph as JSON, nodes by id and edges by their ends."""
    nodes = [{"id": r["id"], "nombre": r["id"].rpartition(".")[2], "tipo": r["tipo"], "capa": r["capa"], "detalle": r["detalle"]} for r in graph.nodes.orderBy("id").collect()]
    edges = [{"origen": r["origen"], "destino": r["destino"], "motivo": "+".join(r["fuentes"]), "confirmada": len(r["fuentes"]) > 1} for r in graph.edges.orderBy("origen", "destino").collect()]
    return json.dumps({"nodos": nodes, "aristas": edges}, ensure_ascii=False, indent=1)
