"""Key-value tables with expiry that micro-batches upsert, as log-structured runs under a manifest.

Every micro-batch writes one run, a folder of its own. A manifest names the runs of a version with their level, newest
batch and last expiry; a new version is published by one rename, so a reader sees the runs of one version, before,
during and after a merge. When ``fan_in`` runs of a level have come together they are merged into one of the next
level, which keeps the latest row of each key and drops expired ones; runs that have expired as a whole are dropped
unread. So there are at most ``fan_in`` runs a level and a number of levels logarithmic in the batches of one TTL.

Runs that no version names any more are removed after ``grace_seconds``, so that readers of an older version can end.
There is one writer, the streaming query. A micro-batch that runs again after a failure is stored again under its
number and a later version, which replaces the first. As the TTL is fixed and time goes on, a later row of a key never
expires before an earlier one, so dropping an expired row cannot bring back an older one.
"""

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from centflow.sources import files


@dataclass(frozen=True)
class Run:
    """A stored run: its folder, level, newest batch and last expiry in microseconds."""

    name: str
    level: int
    newest: int
    expires: int


@dataclass
class Version:
    """The runs of a version, and runs that no reader of it needs with the time they were given up."""

    number: int = 0
    runs: list[Run] = field(default_factory=list)
    retired: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class ExpiringStore:
    """Latest values of ``keys``; ``values`` are the other columns with their types."""

    path: str
    keys: dict[str, str]
    values: dict[str, str]
    ttl_seconds: int
    now: Column | None = None
    fan_in: int = 8
    grace_seconds: int = 3_600

    def _now(self) -> Column:
        return F.current_timestamp() if self.now is None else self.now

    def _clock(self, spark: SparkSession) -> int:
        return spark.range(1).select(F.unix_micros(self._now())).first()[0]

    def version(self, spark: SparkSession) -> Version:
        """The newest published version."""
        folder = f"{self.path}/manifest"
        published = [n for n in files.names(spark, folder) if n.endswith(".json")]
        if not published:
            return Version()
        said = json.loads(files.read_text(spark, f"{folder}/{published[-1]}"))
        return Version(said["number"], [Run(**r) for r in said["runs"]], said["retired"])

    def _publish(self, spark: SparkSession, version: Version) -> None:
        said = {"number": version.number, "runs": [asdict(r) for r in version.runs], "retired": version.retired}
        files.publish_text(spark, f"{self.path}/manifest/{version.number:012d}.json", json.dumps(said))

    def _write(self, rows: DataFrame, level: int, newest: int) -> Run:
        seen, name = Observation(), f"{level}-{newest:012d}-{uuid.uuid4().hex}"
        expires = F.coalesce(F.max(F.unix_micros("expires_at")), F.lit(0)).alias("expires")
        rows.observe(seen, expires).write.parquet(f"{self.path}/runs/{name}")
        return Run(name, level, newest, seen.get["expires"])

    def _rows(self, spark: SparkSession, runs: list[Run]) -> DataFrame:
        columns = self.keys | self.values | {"expires_at": "timestamp", "batch_id": "long", "version": "long"}
        schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
        if not runs:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.path}/runs/{r.name}" for r in runs))

    def _latest(self, rows: DataFrame, now: Column) -> DataFrame:
        rest, order = F.struct(*self.values, "expires_at", "batch_id", "version"), F.struct("batch_id", "version")
        latest = rows.groupBy(*self.keys).agg(F.max_by(rest, order).alias("v")).select(*self.keys, "v.*")
        return latest.where(F.col("expires_at") > now)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Store a micro-batch, merge what has come together, and publish both as one version."""
        spark, old = batch.sparkSession, self.version(batch.sparkSession)
        expires = F.timestamp_micros(F.unix_micros(self._now()) + F.lit(self.ttl_seconds * 1_000_000))
        rows = batch.select(*(F.col(c).cast(kind) for c, kind in (self.keys | self.values).items())).withColumns(
            {"expires_at": expires, "batch_id": F.lit(batch_id).cast("long"), "version": F.lit(old.number + 1).cast("long")})
        clock = self._clock(spark)
        again = [r for r in old.runs if r.level == 0 and r.newest == batch_id]
        runs = [r for r in old.runs if r.expires > clock and r not in again] + [self._write(rows, 0, batch_id)]
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= self.fan_in:
            merged = self._latest(self._rows(spark, full), F.timestamp_micros(F.lit(clock)))
            runs = [r for r in runs if r.level != level] + [self._write(merged, level + 1, max(r.newest for r in full))]
            level += 1
        kept = {r.name for r in runs}
        retired = {r.name: clock for r in old.runs if r.name not in kept} | old.retired
        gone = [name for name, at in retired.items() if clock - at >= self.grace_seconds * 1_000_000]
        self._publish(spark, Version(old.number + 1, runs, {n: at for n, at in retired.items() if n not in gone}))
        self._sweep(spark, gone, kept | set(retired), old.number, batch_id)

    def _sweep(self, spark: SparkSession, gone: list[str], known: set[str], superseded: int, batch_id: int) -> None:
        """Remove runs given up long ago, runs that broken writes of earlier batches left, and old manifests."""
        broken = [n for n in files.names(spark, f"{self.path}/runs") if n not in known and int(n.split("-")[1]) < batch_id]
        for name in {*gone, *broken}:
            files.remove(spark, f"{self.path}/runs/{name}")
        for name in files.names(spark, f"{self.path}/manifest"):
            if name < f"{superseded:012d}":
                files.remove(spark, f"{self.path}/manifest/{name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The keys' latest values that have not expired; runs that have expired as a whole are not read."""
        clock = self._clock(spark)
        rows = self._rows(spark, [r for r in self.version(spark).runs if r.expires > clock])
        return self._latest(rows, self._now()).drop("batch_id", "version")
