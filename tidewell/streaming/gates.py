"""The two gates of the stream: bytes to a JSON object, and the object to a reading.

Both are one projection, on batch and streaming frames alike; nothing raises, what fails
gets a reason. Input: a column of message bytes or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import zoned

REQUIRED = ("indicador_id", "instante", "valor")


def decoded(messages: DataFrame, payload: str = "value") -> DataFrame:
    """messages with original (valid UTF-8 text) and motivo: why it is no JSON object, else null."""
    raw = F.col(payload)
    text = F.make_valid_utf8(raw.cast("string"))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    reason = (
        F.when(raw.isNull(), "DecodeError: mensaje vacío")
        .when(~F.is_valid_utf8(raw.cast("string")), "UnicodeDecodeError: no es UTF-8")
        .when(parsed.isNull(), "JSONDecodeError: no es JSON")
        .when(~kind.startswith("OBJECT"), F.concat(F.lit("TypeError: no es un objeto: "), kind))
    )
    return messages.withColumns({"original": text, "motivo": reason})


def interpreted(objects: DataFrame) -> DataFrame:
    """objects (original, motivo) with indicador_id, instante, valor, and motivo for what can't be read. A field that is null is there but can't be read."""
    text = F.col("original")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))))
    field = lambda name: F.get_json_object(text, f"$.{name}")
    number: Column = field("indicador_id").try_cast("bigint")
    when, value = zoned(field("instante")), field("valor").try_cast("double")
    reason = F.coalesce(
        F.col("motivo"),
        F.when(F.size(missing) > 0, F.concat(F.lit("ValueError: faltan campos: "), F.array_join(missing, ", "))),
        F.when(when.isNull(), "ValueError: instante no es un instante con zona"),
        F.when(number.isNull(), "ValueError: indicador_id no es un entero"),
        F.when(value.isNull(), "ValueError: valor no es un número"),
    )
    return objects.withColumns({"indicador_id": number, "instante": when, "valor": value, "motivo": reason})


def split(messages: DataFrame, received: Column, payload: str = "value") -> tuple[DataFrame, DataFrame]:
    """(readings, rejects) of both gates."""
    read = interpreted(decoded(messages, payload))
    readings = read.where("motivo IS NULL").select("indicador_id", "instante", "valor")
    rejects = read.where("motivo IS NOT NULL").select(received.alias("recibido_en"), "motivo", F.coalesce("original", F.lit("")).alias("original"))
    return readings, rejects


def to_messages(readings: DataFrame) -> DataFrame:
    """Readings as messages: three fields, instants in UTC with their zone."""
    when = F.date_format("instante", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return readings.select(F.to_json(F.struct("indicador_id", when.alias("instante"), "valor")).alias("value"))
