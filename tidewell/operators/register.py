"""Checks of a decision register: each returns the offending rows.

decisions: id, titulo, fecha (date), orden, carril, hito, tipo, impacto, autor, publica (boolean),
alternativas (array of struct elegida, motivo), enlaces (array of struct tipo, destino), abre and cierra (arrays of questions), commit, fecha_commit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import back_edge_paths


def incomplete(decisions: DataFrame) -> DataFrame:
    """Rows without id, title or date."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return decisions.where(blank("id") | blank("titulo") | F.col("fecha").isNull()).select("id", "titulo", "fecha")


def repeated_ids(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("id").agg(F.count("*").alias("veces")).where("veces > 1")


def outside_vocabulary(decisions: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """R2"""
    return decisions.where(F.col(column).isNotNull() & ~F.col(column).isin(*words)).select("id", F.lit(column).alias("campo"), F.col(column).alias("valor"))


def badly_chosen(decisions: DataFrame) -> DataFrame:
    """Not exactly one alternative chosen, or one without a reason."""
    chosen = F.size(F.filter("alternativas", lambda x: x["elegida"]))
    silent = F.exists("alternativas", lambda x: F.coalesce(F.trim(x["motivo"]), F.lit("")) == "")
    return decisions.where(F.col("alternativas").isNotNull() & (F.size("alternativas") > 0) & ((chosen != 1) | silent)).select("id", chosen.alias("elegidas"))


def clashing_order(decisions: DataFrame) -> DataFrame:
    """Places used twice in a day."""
    return decisions.where("orden IS NOT NULL").groupBy("fecha", "orden").agg(F.count("*").alias("veces"), F.array_sort(F.collect_set("id")).alias("ids")).where("veces > 1")


def links(decisions: DataFrame) -> DataFrame:
    return decisions.select("id", F.explode("enlaces").alias("e")).select("id", F.col("e.tipo").alias("tipo"), F.col("e.destino").alias("destino"))


def dangling(decisions: DataFrame) -> DataFrame:
    """Links to decisions that aren't there."""
    return links(decisions).join(decisions.select(F.col("id").alias("destino")).distinct(), "destino", "left_anti").select("id", "tipo", "destino")


def one_sided(decisions: DataFrame, forward: str = "supera_a", backward: str = "superada_por") -> DataFrame:
    """Supersedings that the other side doesn't state."""
    found = links(decisions)
    a = found.where(F.col("tipo") == forward).select("id", "destino")
    b = found.where(F.col("tipo") == backward).select(F.col("destino").alias("id"), F.col("id").alias("destino"))
    return a.join(b, ["id", "destino"], "left_anti").unionByName(b.join(a, ["id", "destino"], "left_anti"))


def causal_cycles(decisions: DataFrame, kind: str = "causada_por", limit: int = 100_000) -> list[list[str]]:
    """Cycles of cause; a register is written by hand, so its links fit on the driver. More than limit of them are an error."""
    rows = links(decisions).where(F.col("tipo") == kind).select("id", "destino").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} links of kind {kind}")
    return back_edge_paths(sorted({r[0] for r in rows}), sorted((r[0], r[1]) for r in rows))


def open_questions(decisions: DataFrame) -> DataFrame:
    """Questions opened and not closed."""
    asked = decisions.select("id", F.explode("abre").alias("cuestion"))
    return asked.join(decisions.select(F.explode("cierra").alias("cuestion")).distinct(), "cuestion", "left_anti").select("cuestion", "id")


def public(decisions: DataFrame) -> DataFrame:
    """Public entries, without their links to others."""
    ids = decisions.where("publica").select("id").distinct()
    kept = links(decisions).join(ids.select(F.col("id").alias("destino")), "destino", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tipo", "destino"))).alias("__e"))
    return decisions.where("publica").drop("enlaces").join(kept, "id", "left").withColumn("enlaces", F.coalesce("__e", F.array().cast("array<struct<tipo:string,destino:string>>"))).drop("__e")


def drifted(decisions: DataFrame, days: int = 1) -> DataFrame:
    """Decisions whose date is further from their commit's, by commit."""
    gap = F.abs(F.datediff("fecha", "fecha_commit"))
    return decisions.where(gap > days).groupBy("commit").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max(gap).alias("dias"))


def inventory(decisions: DataFrame) -> DataFrame:
    """Decisions of each lane."""
    return decisions.groupBy("carril").agg(F.count("*").alias("decisiones"))


def ordered(decisions: DataFrame) -> DataFrame:
    """F8"""
    return decisions.orderBy("fecha", "orden", "id")


LINKS = ("causada_por", "supera_a", "superada_por")  # fixed values: kinds of links in a register file
SCHEMA = "id string, titulo string, fecha date, orden int, carril string, hito string, publica boolean, alternativas array<struct<elegida:boolean,motivo:string>>, enlaces array<struct<tipo:string,destino:string>>"


def read_register(path: str) -> dict:
    """A register file (YAML): proyecto, vocabulario (carriles, hitos), decisiones."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            found = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"{path}: {e}") from e
    if not isinstance(found, dict) or not (found.get("vocabulario") or {}).get("carriles"):
        raise ValueError(f"{path}: a register needs vocabulario with carriles")
    return found


def as_list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def decisions_of(spark: SparkSession, register: dict) -> DataFrame:
    """The decisions of a register file, as the checks want them."""
    rows = []
    for d in register.get("decisiones") or []:
        day = d.get("fecha")
        options = [(bool(a.get("elegida")), a.get("motivo")) for a in as_list(d.get("alternativas"))]
        links = [(kind, str(t)) for kind in LINKS for t in as_list(d.get(kind))]
        rows.append((d.get("id"), d.get("titulo"), date.fromisoformat(str(day)) if day else None, d.get("orden"), d.get("carril"), d.get("hito"), bool(d.get("publica", True)), options, links))
    return spark.createDataFrame(rows, SCHEMA)


def problems(decisions: DataFrame, vocabulary: dict) -> list[str]:
    """What keeps a register from being published, one line for each fault."""
    names = lambda key: [str(x["id"] if isinstance(x, dict) else x) for x in as_list(vocabulary.get(key))]
    faults = [("incompleta", incomplete(decisions)), ("id repetido", repeated_ids(decisions)), ("alternativas", badly_chosen(decisions)), ("orden repetido", clashing_order(decisions)), ("enlace suelto", dangling(decisions)), ("sin reciproco", one_sided(decisions))]
    faults += [("vocabulario", outside_vocabulary(decisions, column, names(key))) for column, key in (("carril", "carriles"), ("hito", "hitos"))]
    found = [f"{name}: {row}" for name, rows in faults for row in rows.toJSON().collect()]
    return found + [f"ciclo: {' -> '.join(path)}" for path in causal_cycles(decisions)]


def script(spark: SparkSession, register: dict, variable: str = "REGISTRO", only_public: bool = False) -> str:
    """A checked register as JavaScript: project, vocabulary, open questions, and decisions by day and place."""
    decisions, vocabulary = decisions_of(spark, register), register["vocabulario"]
    if faults := problems(decisions, vocabulary):
        raise ValueError("; ".join(faults))
    shown = public(decisions).select(decisions.columns) if only_public else decisions
    rows = [json.loads(r) for r in ordered(shown).toJSON().collect()]
    answered = {r.get("hito") for r in rows}
    asked = [h for h in as_list(vocabulary.get("hitos")) if (h["id"] if isinstance(h, dict) else h) not in answered]
    body = {"proyecto": register.get("proyecto") or {}, "vocabulario": vocabulary, "carriles": vocabulary["carriles"], "preguntas_abiertas": asked, "decisiones": rows}
    return f"// Generado; no se edita a mano.\nwindow.{variable} = {json.dumps(body, ensure_ascii=False, indent=2, default=str)};\n"
