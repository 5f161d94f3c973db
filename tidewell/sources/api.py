"""The readings API: a Python data source with one partition for each planned window, and a reader of saved bodies."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.functions.scalars import half_open, utc

RETRIED = (429, 500, 502, 503, 504)  # fixed value: HTTP codes worth another try
TRIES = 3
BODY = "indicator STRUCT<id: BIGINT, name: STRING, values: ARRAY<STRUCT<value: DOUBLE, datetime: STRING, datetime_utc: STRING, geo_id: BIGINT, geo_name: STRING>>>"
READING = "indicador_id bigint, instante timestamp, valor double, geo_id bigint, geo_nombre string"
Transport = Callable[[str, dict], tuple[int, dict, str]]


class RequestFailed(RuntimeError):
    """The API gave no usable answer; code is null where there was no answer at all."""

    def __init__(self, why: str, code: int | None = None, attempts: int = 0) -> None:
        super().__init__(why)
        self.code, self.attempts = code, attempts


class BudgetSpent(RuntimeError):
    """The run's requests, retries among them, are used up."""


def wait_seconds(headers: dict, attempt: int, base: float = 1.0) -> float:
    """Retry-After in seconds or as a date, else base doubled with each attempt."""
    said = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    if said:
        try:
            return max(0.0, float(said))
        except ValueError:
            try:
                return max(0.0, (parsedate_to_datetime(said) - datetime.now(timezone.utc)).total_seconds())
            except (TypeError, ValueError):
                pass
    return base * 2 ** (attempt - 1)


def fetch(transport: Transport, url: str, headers: dict, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, budget: list[int] | None = None) -> tuple[str, int]:
    """(body, attempts). RETRIED codes and connections that fail are tried again; budget[0] falls with each attempt.

    An answer that is no JSON is a failure, and isn't asked for again.
    """
    for attempt in range(1, tries + 1):
        if budget is not None:
            if budget[0] <= 0:
                raise BudgetSpent("no requests left")
            budget[0] -= 1
        try:
            code, answer, body = transport(url, headers)
        except OSError as e:
            code, answer, why = None, {}, f"{type(e).__name__}: {e}"
        else:
            why = f"HTTP {code}"
        if code == 200:
            try:
                json.loads(body)
            except ValueError as e:
                raise RequestFailed(f"unreadable answer: {e}", code, attempt) from e
            return body, attempt
        if code is not None and code not in RETRIED or attempt == tries:
            raise RequestFailed(why, code, attempt)
        sleep(wait_seconds(answer, attempt))
    raise RequestFailed("no tries")


def http(url: str, headers: dict, timeout: float = 30.0) -> tuple[int, dict, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, dict(e.headers), ""


def readings(bodies: DataFrame, body: str = "body", start: str | None = "inicio", end: str | None = "fin") -> DataFrame:
    """A3: readings of JSON bodies: no null values or missing instants, and only instants in [start, end)."""
    point = F.explode("__b.indicator.values").alias("p")
    keep = [c for c in (start, end) if c]
    rows = bodies.withColumn("__b", F.from_json(body, BODY)).select(*keep, F.col("__b.indicator.id").alias("indicador_id"), point)
    flat = rows.select(*keep, "indicador_id", F.coalesce(utc(F.col("p.datetime_utc")), utc(F.col("p.datetime"))).alias("instante"), F.col("p.value").alias("valor"), F.col("p.geo_id").alias("geo_id"), F.col("p.geo_name").alias("geo_nombre"))
    flat = flat.where("valor IS NOT NULL AND instante IS NOT NULL")
    if start and end:
        flat = flat.where(half_open(F.col("instante"), F.col(start), F.col(end)))
    return flat.drop(*keep)


@dataclass
class Window(InputPartition):
    indicator: int
    start: str
    end: str
    tries: int = TRIES


def allowances(windows: int, most: int, tries: int = TRIES) -> list[int]:
    """How often each window may be asked for, so that all of them together, retries among them, stay within ``most`` requests."""
    spare = most - windows
    return [1 + min(tries - 1, spare // windows + (i < spare % windows)) for i in range(windows)]


class ReadingsApi(DataSource):
    """format("readings_api"), options url, token, windows (JSON list of [indicator, start, end]), max_requests, time_trunc."""

    @classmethod
    def name(cls) -> str:
        return "readings_api"

    def schema(self) -> str:
        return "indicador_id bigint, inicio timestamp, fin timestamp, body string, intentos int, segundos double, codigo int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.transport: Transport = http
        self.sleep: Callable[[float], None] = time.sleep

    def partitions(self) -> list[InputPartition]:
        windows = json.loads(self.options["windows"])
        most = int(self.options.get("max_requests", "50"))
        if len(windows) > most:
            raise BudgetSpent(f"{len(windows)} windows, {most} requests")
        return [Window(int(i), a, b, tries) for (i, a, b), tries in zip(windows, allowances(len(windows), most), strict=True)]

    def read(self, partition: Window) -> Iterator[tuple]:
        url = f"{self.options['url']}/{partition.indicator}?start_date={partition.start}&end_date={partition.end}"
        if trunc := self.options.get("time_trunc"):
            url += f"&time_trunc={trunc}"
        headers = {"Accept": "application/json"}
        if token := self.options.get("token"):
            headers["x-api-key"] = token
        began = time.monotonic()
        span = (partition.indicator, datetime.fromisoformat(partition.start), datetime.fromisoformat(partition.end))
        try:
            body, attempts = fetch(self.transport, url, headers, partition.tries, self.sleep)
            yield (*span, body, attempts, time.monotonic() - began, 200, None)
        except RequestFailed as e:
            yield (*span, None, e.attempts, time.monotonic() - began, e.code, str(e))


def saved_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bodies saved as one JSON file each: (body)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def audit(fetched: DataFrame, moment) -> DataFrame:
    """The audit rows of what was fetched."""
    points = F.coalesce(F.size(F.from_json("body", BODY)["indicator"]["values"]), F.lit(0))
    return fetched.select(moment.alias("momento"), "indicador_id", F.col("inicio").alias("ventana_inicio"), F.col("fin").alias("ventana_fin"), F.col("codigo").cast("long").alias("codigo"), F.col("intentos").cast("long").alias("intentos"), F.greatest(points, F.lit(0)).cast("long").alias("puntos"), "segundos", F.nullif("error", F.lit("")).alias("error"))
