"""SQLite recordings as a Spark data source, and the frame store's schema rules."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA_VERSION = 4
OLDEST = 2
FRAMES = "sensor string, ts double, ts_mono double, move binary, still binary, distance_cm int, device_occ int"


class SensorPart(InputPartition):
    def __init__(self, sensor: str):
        self.sensor = sensor


class RecordingReader(DataSourceReader):
    """One partition a sensor; time bounds go into the database's own range scan."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.end = float(options.get("start", "-inf")), float(options.get("end", "inf"))
        self.only = options.get("sensor")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[SensorPart]:
        with self._open() as db:
            found = [r[0] for r in db.execute("SELECT DISTINCT sensor_id FROM frames ORDER BY sensor_id")]
        return [SensorPart(s) for s in found if self.only in (None, s)]

    def read(self, partition: SensorPart) -> Iterator[tuple]:
        sql = "SELECT sensor_id, ts, ts_mono, move, still, distance_cm, device_occ FROM frames WHERE sensor_id = ? AND ts >= ? AND ts < ? ORDER BY ts"
        with self._open() as db:
            yield from db.execute(sql, (partition.sensor, self.start, self.end))


class Recording(DataSource):
    """spark.read.format("recording").option("path", file)[.option("sensor"|"start"|"end", ...)].load()"""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def read_recording(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Frames of a recording with gates as arrays."""
    from gatelens.functions.arrays import bytes_to_gates
    from gatelens.session import on_workers

    on_workers(spark).dataSource.register(Recording)
    rows = spark.read.format("recording").option("path", path).options(**options).load()
    return rows.withColumns({"move": bytes_to_gates(F.col("move")), "still": bytes_to_gates(F.col("still")), "device_occ": F.col("device_occ") == 1, "id": F.lit(0).cast("long")})


def write_recording(path: str, frames: list[tuple], version: int = SCHEMA_VERSION) -> None:
    """A small recording: (sensor, ts, ts_mono, move, still, distance_cm, device_occ) rows."""
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE schema_info (version INTEGER)")
        db.execute("INSERT INTO schema_info VALUES (?)", (version,))
        db.execute("CREATE TABLE frames (sensor_id TEXT, ts REAL, ts_mono REAL, move BLOB, still BLOB, distance_cm INTEGER, device_occ INTEGER, PRIMARY KEY (sensor_id, ts))")
        db.executemany("INSERT INTO frames VALUES (?, ?, ?, ?, ?, ?, ?)", [(s, t, m, bytes(a), bytes(b), d, int(o)) for s, t, m, a, b, d, o in frames])


def schema_version(path: str) -> int:
    """The recording's schema version; ValueError if it is too old to migrate."""
    with sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True) as db:
        found = db.execute("SELECT max(version) FROM schema_info").fetchone()[0]
    if found is None or found < OLDEST:
        raise ValueError(f"schema version {found} is older than {OLDEST}")
    return found


#: Columns that later versions added to episodes; older tables get them as nulls.
ADDED = {"gate_peaks": "binary", "leading_gate": "int"}


def migrated(episodes: DataFrame) -> DataFrame:
    """Episodes of any readable version in the present schema: added columns are null."""
    return episodes.withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items() if c not in episodes.columns})
