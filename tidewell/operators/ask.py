"""Questions about the lineage graph in plain Spanish, and the exact evaluation of the answers.

Reading a question is a set of column expressions, so a bank of any size is read in
one projection; answering one needs the graph and happens on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import plain, ratio

from .lineage import AmbiguousNode, Graph, UnknownNode

# The phrases that give an operation away, the number words and the words that are no tables.
SIGNALS: dict[str, tuple[str, ...]] = {
    "linaje": (
        "de donde sale", "de donde viene", "de donde salen", "de que depende", "que alimenta", "quien alimenta", "origen de",
        "procede", "aguas arriba", "linaje", "de que se construye", "con que se construye", "de que bebe",
    ),
    "impacto": (
        "que se rompe", "que rompo", "que rompe", "que pasa si", "a que afecta", "que afecta", "impacto", "aguas abajo", "quien usa",
        "quien consume", "quien depende", "que depende de", "si borro", "si cambio", "si toco", "si modifico", "que deja de funcionar", "consumidores",
    ),
    "huerfanas": (
        "huerfana", "no consulta nadie", "nadie consulta", "nadie usa", "no usa nadie", "se puede borrar", "puedo borrar",
        "sin consumidores", "que sobra", "sin usar", "no se usa", "no se use", "que no se use",
    ),
    "ciclos": ("ciclo", "circular", "bucle", "dependencias rotas", "se muerde la cola"),
    "resumen": ("cuantas tablas", "cuantos nodos", "resumen", "que hay en", "como es el grafo", "cuantas dependencias", "tamano del grafo"),
}
NUMBER_WORDS = (("un", 1), ("primer", 1), ("dos", 2), ("segundo", 2), ("tres", 3), ("tercer", 3), ("cuatro", 4), ("cinco", 5))
# The shapes of a depth ("a dos saltos") and of a table's name (back-ticked, dotted, with underscores, or a loose word); which
# questions name a table or a depth depends on these alone.
HOPS = r"(?i)(?:a|hasta|solo|en)\s+(?:el\s+|los\s+|las\s+)?(\d+|un|uno|una|dos|tres|cuatro|cinco|primer\w*|segundo|tercer\w*)\s*(?:salto|nivel|paso|capa)"
SHAPED = r"(?i)`[^`]+`|\b[a-z0-9_-]+(?:\.[a-z0-9_-]+){1,2}\b|\b[a-z]+(?:_+[a-z0-9]+)+\b"
LOOSE = r"\b([a-z][a-z0-9_]{3,})\b"
# Words that are no tables, and abbreviations with a dot.
WORDS = (
    "afecta", "aguas", "abajo", "arriba", "algun", "alguna", "algo", "antes", "borrar", "borro", "cambio", "columna", "como", "consume", "consulta",
    "consultan", "consumidores", "cual", "cuando", "cuanto", "cuantas", "cuantos", "datos", "deja", "depende", "dependencias", "desde", "dime", "donde",
    "ejemplo", "entonces", "esta", "estan", "este", "esto", "funcionar", "grafo", "hasta", "impacto", "linaje", "modifico", "nadie", "nivel", "niveles",
    "origen", "para", "pasa", "puedo", "puede", "quien", "rompe", "rompo", "salto", "saltos", "sale", "salen", "sobra", "tabla", "tablas", "toco",
    "todas", "todos", "usan", "circulares", "circular", "ciclo", "ciclos", "muerde", "cola", "resumen", "llovido", "madrid", "hoy", "pedidos",
)
ABBREVIATIONS = ("etc", "p.ej", "ej")
NO_TABLES = (*WORDS, *ABBREVIATIONS)
ABOUT_A_TABLE = ("impacto", "linaje")


def operation(question: Column) -> Column:
    """L2: the operation of the longest phrase in the question, the first by letter on ties; ``desconocida`` without one."""
    ranked = sorted(((s, op) for op, signals in SIGNALS.items() for s in signals), key=lambda x: (-len(x[0]), x[0]))
    flat = plain(question)
    found = F.coalesce(*[F.when(flat.contains(s), F.lit(op)) for s, op in ranked])
    return F.coalesce(found, F.lit("desconocida"))


def shaped(question: Column) -> Column:
    """Names that look like tables: back-ticked, dotted or with underscores, in order."""
    names = F.transform(F.regexp_extract_all(question, F.lit(SHAPED), F.lit(0)), lambda x: F.lower(F.replace(x, F.lit("`"), F.lit(""))))
    return F.array_distinct(F.filter(names, lambda x: ~x.isin(*NO_TABLES)))


def candidates(question: Column) -> Column:
    """L3: shaped names, then loose words of four letters or more that may be tables."""
    loose = F.filter(F.regexp_extract_all(plain(question), F.lit(LOOSE), F.lit(1)), lambda x: ~x.isin(*NO_TABLES))
    return F.array_distinct(F.concat(shaped(question), loose))


def hops(question: Column) -> Column:
    """L4: how many levels the question asks for, in digits or words; null if it doesn't say."""
    raw = F.nullif(F.regexp_extract(plain(question), HOPS, 1), F.lit(""))
    word = F.coalesce(*[F.when(raw.startswith(w), F.lit(n)) for w, n in NUMBER_WORDS])
    return F.coalesce(raw.try_cast("int"), word)


def interpret(questions: DataFrame, column: str = "pregunta") -> DataFrame:
    """Questions with operacion, tabla, candidatos, saltos, confianza, completa."""
    q = F.coalesce(F.col(column), F.lit(""))
    op = operation(q)
    needs = op.isin(*ABOUT_A_TABLE)
    read = questions.withColumns({"operacion": op, "tabla": F.when(needs, F.get(shaped(q), F.lit(0))), "candidatos": F.when(needs, candidates(q)).otherwise(F.array().cast("array<string>")), "saltos": hops(q)})
    complete = (F.col("operacion") != "desconocida") & (~F.col("operacion").isin(*ABOUT_A_TABLE) | (F.size("candidatos") > 0))
    trust = F.when(F.col("operacion") == "desconocida", 0.0).when(complete, 0.9).otherwise(0.4)
    return read.withColumns({"confianza": trust, "completa": complete})


@dataclass
class Answer:
    operation: str
    tables: set[str] = field(default_factory=set)
    text: str = ""
    error: str | None = None


def answer(graph: Graph, op: str, names: list[str], depth: int | None = None) -> Answer:
    """Runs an operation. Only tables of the graph are ever answered."""
    if op in ABOUT_A_TABLE:
        if not names:
            return Answer(op, error="la pregunta no dice de qué tabla")
        node, why = None, ""
        for name in names:
            try:
                node = graph.resolve(name)
                break
            except (UnknownNode, AmbiguousNode) as e:
                why = why or str(e)
        if node is None:
            return Answer(op, error=why)
        rows = (graph.ancestry if op == "linaje" else graph.impact)(node, depth).collect()
        return Answer(op, {r["id"] for r in rows}, f"{node}: " + (", ".join(f"{r['id']} ({r['salto']})" for r in rows) or "nada"))
    if op == "huerfanas":
        found = [r["id"] for r in graph.orphans().collect()]
        return Answer(op, set(found), ", ".join(found) or "todas las tablas tienen quien las lea")
    if op == "ciclos":
        paths = graph.cycles()
        return Answer(op, {n for p in paths for n in p}, "; ".join(" -> ".join(p) for p in paths) or "sin ciclos")
    if op == "resumen":
        return Answer(op, {r["id"] for r in graph.nodes.select("id").collect()}, ", ".join(f"{r['medida']}={r['valor']}" for r in graph.summary().collect()))
    return Answer(op, error="no entiendo la pregunta: sé de linaje, impacto, tablas huérfanas, ciclos y del resumen del grafo")


def ask(spark: SparkSession, graph: Graph, question: str) -> Answer:
    row = interpret(spark.createDataFrame([(question,)], "pregunta string")).first()
    return answer(graph, row["operacion"], list(row["candidatos"]), row["saltos"])


def scores(cases: DataFrame) -> DataFrame:
    """Cases (esperadas, dadas: arrays) with aciertos, faltan, sobran, precision, recall, f2, exacta.

    Both sets empty count as 1, one of them empty as 0.
    """
    want, got = F.array_distinct("esperadas"), F.array_distinct("dadas")
    hits = F.array_intersect(want, got)
    both = (F.size(want) == 0) & (F.size(got) == 0)
    rate = lambda n: F.when(both, 1.0).otherwise(F.coalesce(ratio(F.size(hits), F.size(n)), F.lit(0.0)))
    out = cases.withColumns({"aciertos": F.array_sort(hits), "faltan": F.array_sort(F.array_except(want, got)), "sobran": F.array_sort(F.array_except(got, want)), "precision": rate(got), "recall": rate(want)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f2": F.coalesce(ratio(5 * p * r, 4 * p + r), F.lit(0.0)), "exacta": (F.size("faltan") == 0) & (F.size("sobran") == 0)})


def report(scored: DataFrame) -> DataFrame:
    """One row: cases, mean precision, recall and F2, exact answers, right operations."""
    right = F.count_if(F.col("operacion") == F.col("operacion_dada")) if {"operacion", "operacion_dada"} <= set(scored.columns) else F.lit(None).cast("long")
    return scored.agg(F.count("*").alias("casos"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f2").alias("f2"), F.count_if("exacta").alias("exactas"), right.alias("operaciones"))


def failures(scored: DataFrame) -> DataFrame:
    """Cases that are not exact, those with missing tables first."""
    return scored.where("NOT exacta").orderBy((F.size("faltan") == 0).cast("int"), "pregunta")


def evaluate(spark: SparkSession, graph: Graph, cases: list[dict], project: str = "") -> DataFrame:
    """Scored cases. A case has pregunta, operacion, esperadas and maybe tabla, saltos, nota."""
    bank = spark.createDataFrame([(i, c["pregunta"], c["operacion"], [full_name(t, project) for t in c.get("esperadas") or []]) for i, c in enumerate(cases)], "n int, pregunta string, operacion string, esperadas array<string>")
    given = []
    for row in interpret(bank.drop("operacion")).select("n", "operacion", "candidatos", "saltos").collect():
        found = answer(graph, row["operacion"], list(row["candidatos"]), row["saltos"])
        given.append((row["n"], row["operacion"], sorted(found.tables), found.error))
    return scores(bank.join(spark.createDataFrame(given, "n int, operacion_dada string, dadas array<string>, error string"), "n"))


def full_name(table: str, project: str) -> str:
    """A bank's table name with its project, in lower case."""
    table = table.lower()
    return table if not project or table.startswith(f"{project.lower()}.") or "." not in table else f"{project.lower()}.{table}"


def load_bank(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)["casos"]


def looks_like_table(name: str) -> bool:
    return bool(re.fullmatch(SHAPED, name))
