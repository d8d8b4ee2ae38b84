"""Versioned imports on plain files.

Data partitions are written once and never changed. What happened to an import is an append-only
event log of small files; the current state is read from the log, so a half-written partition is
never visible. One writer at a time is assumed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = (
    "seq bigint, import_id bigint, status string, attempt bigint, version bigint, exclude_repeats boolean, "
    "source string, rows bigint, error string, at timestamp"
)
VISITS = "visit_id bigint, seq bigint, voided boolean, locality_raw string, locality_key string, visit_date date, search_result string, lat double, lng double, notes string"


class VersionError(RuntimeError):
    """A step that the current status of an import does not allow; ``args[0]`` is a code."""


@dataclass(frozen=True)
class Versions:
    spark: SparkSession
    path: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def events(self) -> DataFrame:
        if not self._exists(self._at("events")):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).json(self._at("events"))

    def status(self) -> DataFrame:
        """The latest event of every import."""
        latest = self.events().groupBy("import_id").agg(F.max_by(F.struct("*"), "seq").alias("e"))
        return latest.select("e.*")

    def active(self) -> DataFrame:
        return self.status().where("status = 'active'")

    def _record(self, *rows: dict) -> None:
        start = (self.events().agg(F.max("seq")).first()[0] or 0) + 1
        base = dict.fromkeys(f.split()[0] for f in EVENTS.split(", "))
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        full = [tuple({**base, **r, "seq": start + i, "at": now}.values()) for i, r in enumerate(rows)]
        # one file per step: either all of its events are visible or none
        self.spark.createDataFrame(full, EVENTS).coalesce(1).write.mode("append").json(self._at("events"))

    def _one(self, import_id: int, *allowed: str):
        row = self.status().where(F.col("import_id") == import_id).first()
        if row is None:
            raise VersionError("unknown_import")
        if row.status not in allowed:
            raise VersionError(f"is_{row.status}")
        return row

    def _write(self, import_id: int, attempt: int, records: DataFrame | None, errors: list[str], source: str) -> None:
        event = {"import_id": import_id, "attempt": attempt, "source": source}
        if errors or records is None:
            self._record({**event, "status": "failed", "error": ",".join(errors) or "no_records"})
            return
        target = self._at("data", f"import_id={import_id}", f"attempt={attempt}")
        try:
            records.write.mode("errorifexists").parquet(target)
        except Exception as e:
            self._record({**event, "status": "failed", "error": type(e).__name__})
            raise
        self._record({**event, "status": "staged", "rows": self.spark.read.parquet(target).count()})

    def stage(self, records: DataFrame | None, source: str, errors: list[str] | None = None) -> int:
        """Write records apart from the active version; errors make the import fail."""
        import_id = (self.events().agg(F.max("import_id")).first()[0] or 0) + 1
        self._write(import_id, 1, records, errors or [], source)
        return import_id

    def remap(self, import_id: int, records: DataFrame | None, errors: list[str] | None = None) -> None:
        """Replace the rows of an import that was not activated yet."""
        row = self._one(import_id, "staged", "failed")
        self._write(import_id, row.attempt + 1, records, errors or [], row.source)

    def activate(self, import_id: int, exclude_repeats: bool = False) -> int:
        row = self._one(import_id, "staged")
        version = (self.events().agg(F.max("version")).first()[0] or 0) + 1
        self._record(
            *self._archived(),
            {**self._kept(row), "status": "active", "version": version, "exclude_repeats": exclude_repeats},
        )
        return version

    def restore(self, import_id: int) -> None:
        row = self._one(import_id, "archived")
        self._record(*self._archived(), {**self._kept(row), "status": "active"})

    def discard(self, import_id: int) -> None:
        row = self._one(import_id, "staged", "failed")
        self._record({**self._kept(row), "status": "discarded"})

    @staticmethod
    def _kept(row) -> dict:
        return {k: row[k] for k in ("import_id", "attempt", "version", "exclude_repeats", "source", "rows")}

    def _archived(self) -> list[dict]:
        return [{**self._kept(r), "status": "archived"} for r in self.active().collect()]  # one row at most

    # -------------------------------------------------------------- manual visits

    def _visit_log(self) -> DataFrame:
        if not self._exists(self._at("visits")):
            return self.spark.createDataFrame([], VISITS)
        return self.spark.read.schema(VISITS).json(self._at("visits"))

    def _append_visit(self, row: dict) -> None:
        base = dict.fromkeys(f.split()[0] for f in VISITS.split(", "))
        seq = (self._visit_log().agg(F.max("seq")).first()[0] or 0) + 1
        full = tuple({**base, **row, "seq": seq}.values())
        self.spark.createDataFrame([full], VISITS).coalesce(1).write.mode("append").json(self._at("visits"))

    def add_visit(
        self, locality: str, key: str, date: dt.date, result: str, lat: float | None = None, lng: float | None = None, notes: str | None = None
    ) -> int:
        if result not in ("com_captura", "sem_captura"):
            raise VersionError("invalid_result")
        if (lat is None) != (lng is None):
            raise VersionError("incomplete_position")
        known = self.active_records().where(F.col("locality_key") == key).agg(F.min("locality_raw")).first()[0]
        visit_id = (self._visit_log().agg(F.max("visit_id")).first()[0] or 0) + 1
        self._append_visit(
            {
                "visit_id": visit_id, "voided": False, "locality_raw": known or locality, "locality_key": key, "visit_date": date,
                "search_result": result, "lat": lat, "lng": lng, "notes": notes,
            }
        )
        return visit_id

    def void_visit(self, visit_id: int) -> None:
        if self.visits().where(F.col("visit_id") == visit_id).isEmpty():
            raise VersionError("unknown_visit")
        self._append_visit({"visit_id": visit_id, "voided": True})

    def visits(self) -> DataFrame:
        log = self._visit_log()
        return log.where("not voided").join(log.where("voided").select("visit_id"), "visit_id", "left_anti")

    # -------------------------------------------------------------- reading

    def active_records(self) -> DataFrame:
        """Rows of the active version; only its partition is read."""
        row = self.active().first()
        if row is None:
            return self.spark.createDataFrame([], "rid string, origin string, locality_key string, locality_raw string")
        df = self.spark.read.parquet(self._at("data", f"import_id={row.import_id}", f"attempt={row.attempt}"))
        if row.exclude_repeats and "duplicate_of" in df.columns:
            df = df.where("duplicate_of is null")
        order = [c for c in ("index", "rid") if c in df.columns]
        rid = F.concat(F.lit("f"), F.col(order[0]).cast("string")) if order and order[0] == "index" else None
        out = df.withColumn("origin", F.lit("arquivo"))
        return out.withColumn("rid", rid) if rid is not None else out

    def records(self) -> DataFrame:
        """The unified view: the active version and the manual visits that were not voided."""
        manual = self.visits().select(
            F.concat(F.lit("m"), F.col("visit_id").cast("string")).alias("rid"),
            F.lit("manual").alias("origin"),
            F.lit("visita").alias("type"),
            "locality_key",
            "locality_raw",
            "visit_date",
            "search_result",
            F.lit("nao_informado").alias("exam_result"),
            "lat",
            "lng",
            F.lit(False).alias("is_boundary"),
            "notes",
        )
        return self.active_records().unionByName(manual, allowMissingColumns=True)
