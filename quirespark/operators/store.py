"""A store of corrections as an append-only log of events, with the commands that read and write it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.text import compact
from quirespark.operators import records
from quirespark.sources.documents import content_hash, export_sorted
from quirespark.sources.tables import cut

VERSION = 1
KEY = ["expression", "domain", "fingerprint", "preferred"]
FIELDS = "expression string, domain string, fingerprint string, preferred string"
LOG = f"{FIELDS}, at timestamp_ntz, n long, action string, version int"
COMMANDS = ("add", "list", "revoke", "restore", "delete", "clear", "export")


class CorrectionStore:
    """Corrections in a Parquet folder of events; what holds now is a replay of the log, so writers only append."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path) if self._exists() else self.spark.createDataFrame([], LOG)

    def current(self) -> DataFrame:
        return records.current_records(self.log().drop("version").withColumn("last_action", F.col("action")), KEY, ["at", "n"])

    def problems(self) -> DataFrame:
        """Events that the log may not hold: unknown actions or versions, missing or unnormal fields, no time."""
        sound = F.col("action").isin(*records.ACTIONS) & (F.col("version") == VERSION) & F.col("at").isNotNull()
        for field in KEY:
            sound = sound & F.col(field).isNotNull() & compact(F.col(field), 240).eqNullSafe(F.col(field))
        return self.log().where(~F.coalesce(sound, F.lit(False)))

    def execute(self, command: str, rows: DataFrame | None = None, at: str | None = None) -> DataFrame | int:
        """One command; ``rows`` hold ``FIELDS``, ``at`` is the caller's clock. Writing gives the number of events, reading rows.

        'add' takes rows of valid fields only; 'revoke', 'restore' and 'delete' only records that are there; others are left
        out and not counted. An unknown command is an error.
        """
        if command not in COMMANDS:
            raise ValueError(f"unknown command {command}")
        if command == "list":
            return self.current().where("status = 'active'").orderBy(*KEY)
        if command == "export":
            export_sorted(self.current(), at, KEY)
            return self.current().count()
        action = "delete" if command == "clear" else command
        if command == "add":
            chosen = rows.select(*[compact(F.col(f), 240).alias(f) for f in KEY]).dropna().distinct()
        else:
            there = self.current().select(*KEY)
            chosen = there if command == "clear" else there.join(rows.select(*KEY).distinct(), KEY, "left_semi")
        last = self.log().agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        event = chosen.withColumns({"at": F.lit(at).cast("timestamp_ntz"), "n": F.lit(last + 1).cast("long"), "action": F.lit(action), "version": F.lit(VERSION)})
        made = cut(event.select(*[c.split()[0] for c in LOG.split(", ")]))  # the log that it was made from is written to
        number = made.count()
        if number:
            made.write.mode("append").parquet(self.path)
        return number


def published(frame: DataFrame, gates: DataFrame, key: str, path: str) -> str:
    """Writes the rows of keys whose gates all passed to a new folder and reads them back; an existing one is an error.

    ``gates``: key, passed; a null counts as failed, and a key without any gate is not published. The content's hash after
    writing must be that before.
    """
    good = gates.groupBy(key).agg(F.min(F.coalesce("passed", F.lit(False))).alias("good")).where("good").select(key)
    chosen = frame.join(good, key, "left_semi")
    before = content_hash(chosen)
    chosen.write.mode("errorifexists").parquet(path)
    if content_hash(frame.sparkSession.read.parquet(path)) != before:
        raise ValueError(f"{path} does not hold what was to be published")
    return before


def chained_gates(gates: DataFrame, key: str, parents: dict[str, str | None]) -> DataFrame:
    """key, gate, status of each gate in the order of ``parents`` (gate and the one it depends on): 'passed', 'failed', or
    'skipped' where the gate it depends on did not pass or was skipped itself. A gate without a row has failed."""
    wide = gates.groupBy(key).pivot("gate", list(parents)).agg(F.min("passed"))
    status: dict[str, object] = {}
    for gate, parent in parents.items():
        own = F.when(F.coalesce(F.col(gate), F.lit(False)), "passed").otherwise("failed")
        status[gate] = own if parent is None else F.when(status[parent] != "passed", "skipped").otherwise(own)
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), s.alias("status")) for g, s in status.items()])
    return wide.select(key, F.explode(rows).alias("g")).select(key, "g.gate", "g.status")
