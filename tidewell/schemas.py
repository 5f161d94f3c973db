"""Every table's schema, declared once, and its JSON export."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the published tables.
_TYPES = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def wire(kinds: list[tuple[str, str]], row: tuple) -> bytes:
    """A row in the protocol-buffer wire format: wire type 0 for integers, booleans and microseconds, 1 for doubles, 2 for text."""
    out = b""
    for number, ((_, kind), value) in enumerate(zip(kinds, row, strict=True), 1):
        if value is None:
            continue
        if kind == "FLOAT":
            out += _varint(number << 3 | 1) + struct.pack("<d", value)
        elif kind == "STRING":
            text = value.encode()
            out += _varint(number << 3 | 2) + _varint(len(text)) + text
        else:
            out += _varint(number << 3) + _varint(int(value))
    return out


@dataclass(frozen=True)
class Table:
    """A table: its columns (name, type, mode), partition column and clustering."""

    name: str
    columns: tuple[tuple[str, str, str], ...]
    partition: str | None = None
    clustering: tuple[str, ...] = ()
    comments: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[t], m != "REQUIRED", {"comment": self.comments[n]} if n in self.comments else {}) for n, t, m in self.columns])

    def to_json(self) -> str:
        """Warehouse-style schema file: one object for each column, in order."""
        return json.dumps([{"name": n, "type": t, "mode": m, "description": self.comments.get(n, "")} for n, t, m in self.columns], indent=2, ensure_ascii=False)

    def missing(self, df: DataFrame) -> DataFrame:
        """Rows of df that leave a required column null, with the column's name: checked before a write, as Parquet relaxes it."""
        required = [n for n, _, m in self.columns if m == "REQUIRED"]
        empty = F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in required]), lambda x: x.isNotNull())
        return df.withColumn("missing", empty).where(F.size("missing") > 0)

    def encoded(self, df: DataFrame) -> DataFrame:
        """(message): each row in the protocol-buffer wire format, fields numbered in the order of the columns.

        Instants travel as microseconds, zeros and false are sent, nulls are left out, a null in a required column raises.
        """
        kinds = [(n, t) for n, t, _ in self.columns]
        rows = self.conform(df).select(*[F.unix_micros(n).alias(n) if t == "TIMESTAMP" else F.col(n) for n, t in kinds])

        def encode(batches):
            import pyarrow as pa

            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([pa.array([wire(kinds, row) for row in zip(*columns, strict=True)], pa.binary())], ["message"])

        return rows.mapInArrow(encode, "message binary")

    def conform(self, df: DataFrame) -> DataFrame:
        """df with exactly this table's columns, in order and of its types; a null in a required column raises, naming it."""
        out = []
        for n, t, m in self.columns:
            c = F.col(n).cast(_TYPES[t])
            if m == "REQUIRED":
                c = F.coalesce(c, F.raise_error(F.lit(f"{self.name}.{n} is required")).cast(_TYPES[t]))
            out.append(c.alias(n))
        return df.select(*out)


READINGS = Table(
    "raw.medidas",
    (("indicador_id", "INTEGER", "REQUIRED"), ("instante", "TIMESTAMP", "REQUIRED"), ("valor", "FLOAT", "REQUIRED"), ("geo_id", "INTEGER", "NULLABLE"), ("geo_nombre", "STRING", "NULLABLE"), ("ingerido_en", "TIMESTAMP", "REQUIRED")),
    "instante",
    ("indicador_id",),
)
WATERMARKS = Table("control.marca_de_agua", (("indicador_id", "INTEGER", "REQUIRED"), ("hasta", "TIMESTAMP", "REQUIRED"), ("actualizado_en", "TIMESTAMP", "REQUIRED")))
REQUESTS = Table(
    "control.peticiones",
    (("momento", "TIMESTAMP", "REQUIRED"), ("indicador_id", "INTEGER", "REQUIRED"), ("ventana_inicio", "TIMESTAMP", "REQUIRED"), ("ventana_fin", "TIMESTAMP", "REQUIRED"), ("codigo", "INTEGER", "NULLABLE"), ("intentos", "INTEGER", "REQUIRED"), ("puntos", "INTEGER", "REQUIRED"), ("segundos", "FLOAT", "REQUIRED"), ("error", "STRING", "NULLABLE")),
    "momento",
)
PANES = Table(
    "stream.potencia_horaria",
    (("hora", "TIMESTAMP", "REQUIRED"), ("indicador_id", "INTEGER", "REQUIRED"), ("potencia_media_mw", "FLOAT", "REQUIRED"), ("potencia_min_mw", "FLOAT", "REQUIRED"), ("potencia_max_mw", "FLOAT", "REQUIRED"), ("lecturas", "INTEGER", "REQUIRED"), ("hora_completa", "BOOLEAN", "REQUIRED"), ("panel", "INTEGER", "REQUIRED"), ("es_tardio", "BOOLEAN", "REQUIRED"), ("emitido_en", "TIMESTAMP", "REQUIRED")),
    "hora",
    ("indicador_id",),
)
REJECTS = Table("stream.rechazos", (("recibido_en", "TIMESTAMP", "REQUIRED"), ("motivo", "STRING", "REQUIRED"), ("original", "STRING", "REQUIRED")))
TECHNOLOGIES = Table(
    "tecnologias",
    (("indicador_id", "INTEGER", "REQUIRED"), ("tecnologia", "STRING", "REQUIRED"), ("familia", "STRING", "REQUIRED"), ("renovable", "BOOLEAN", "NULLABLE"), ("min_mw", "FLOAT", "REQUIRED"), ("max_mw", "FLOAT", "REQUIRED"), ("nota_rango", "STRING", "NULLABLE"), ("sumable", "BOOLEAN", "REQUIRED"), ("orden_apilado", "INTEGER", "REQUIRED")),
)
ALL = (READINGS, WATERMARKS, REQUESTS, PANES, REJECTS, TECHNOLOGIES)
