"""Table references in SQL text: by Catalyst's parser on the driver, and by column expressions for many texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of references.
AFTER_KEYWORD = r"(?i)\b(?:from|join|merge\s+into|merge|using|update|insert\s+into|into)\s+`?([a-z0-9_\-]+(?:\.[a-z0-9_\-]+){1,2})`?"
AFTER_CALL = r"(?i)\bcall\s+`?([a-z0-9_\-]+(?:\.[a-z0-9_\-]+){1,2})`?"
IN_COMMENT = r"(?i)([a-z_][a-z0-9_\-]*(?:\.[a-z_][a-z0-9_\-]*){1,2})"
RESERVED = ("select", "unnest", "lateral", "values", "table", "with", "as", "on", "where")
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n]*"


@dataclass
class Reading:
    """What a text refers to; approximate if the parser couldn't read it."""

    references: set[str] = field(default_factory=set)
    commented: set[str] = field(default_factory=set)
    approximate: bool = False
    error: str | None = None


def without_comments(sql: Column) -> Column:
    """K5: block comments first, then line comments."""
    return F.regexp_replace(F.regexp_replace(sql, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def comments(sql: Column) -> Column:
    """The text of all comments."""
    blocks = F.regexp_extract_all(sql, F.lit(f"({BLOCK_COMMENT})"), F.lit(1))
    lines = F.regexp_extract_all(F.regexp_replace(sql, BLOCK_COMMENT, " "), F.lit(f"({LINE_COMMENT})"), F.lit(1))
    return F.array_join(F.concat(blocks, lines), "\n")


def references(sql: Column) -> Column:
    """K3: sorted references after keywords and CALL, comments left out."""
    bare = without_comments(F.coalesce(sql, F.lit("")))
    found = F.concat(F.regexp_extract_all(bare, F.lit(AFTER_KEYWORD), F.lit(1)), F.regexp_extract_all(bare, F.lit(AFTER_CALL), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(x)), lambda x: ~x.isin(*RESERVED))))


def commented(sql: Column) -> Column:
    """K4: sorted names that stand in comments, hints of removed dependencies."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(comments(F.coalesce(sql, F.lit(""))), F.lit(IN_COMMENT), F.lit(1)), lambda x: F.lower(x))))


def read(spark: SparkSession, sql: str | None) -> Reading:
    """K1, K2: the parser's references and the pattern's together; CTE names and names without a dot are none."""
    if not sql or not sql.strip():
        return Reading()
    blocks = re.findall(BLOCK_COMMENT, sql)
    bare = re.sub(BLOCK_COMMENT, " ", sql)
    lines = re.findall(LINE_COMMENT, bare)
    bare = re.sub(LINE_COMMENT, " ", bare)
    out = Reading(commented={x.lower() for x in re.findall(IN_COMMENT, "\n".join([*blocks, *lines]))})
    pattern = {x.lower() for p in (AFTER_KEYWORD, AFTER_CALL) for x in re.findall(p, bare)} - set(RESERVED)
    ctes: set[str] = set()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare.strip().rstrip(";"))
        parsed, ctes = _unresolved(spark, plan)
    except Exception as e:  # noqa: BLE001  any text may come here
        out.approximate, out.error, parsed = True, str(e).strip().splitlines()[0][:300], set()
        ctes = {x.lower() for x in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)`?([a-z_][a-z0-9_]*)`?\s+as\s*\(", bare)}
    found = parsed | pattern
    out.references = {x for x in found if "." in x and x not in ctes and x.rpartition(".")[2] not in ctes or "." in x and x in parsed and x.rpartition(".")[2] not in ctes}
    return out


def _unresolved(spark: SparkSession, plan) -> tuple[set[str], set[str]]:
    """Multipart names of the unresolved relations and procedures of a parsed plan, subqueries included, and its CTE names."""
    fields = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields)
    spark.conf.set(fields, str(2**31 - 1))  # no list of names is cut short
    try:
        text = plan.toString()
    finally:
        spark.conf.set(fields, before)
    names = re.findall(r"'?Unresolved(?:Relation|Procedure|TableOrView|Table|Identifier) \[([^\]]+)\]", text)
    ctes = {x.strip().lower() for group in re.findall(r"CTE \[([^\]]+)\]", text) for x in group.split(",")}
    found = {".".join(p.strip().strip("`") for p in n.split(",")).lower() for n in names}
    return {x for x in found if "." in x}, ctes


def extract(definitions: DataFrame, name: str = "id", sql: str = "sql") -> DataFrame:
    """Edges (origen, destino, motivo) from many definitions, without the parser: nothing is collected."""
    refs = definitions.select(F.lower(name).alias("destino"), F.explode(references(F.col(sql))).alias("origen"))
    return refs.where("origen <> destino").select("origen", "destino", F.lit("sql").alias("motivo"))
