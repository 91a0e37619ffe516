"""Tables whose partitions are replaced together, in one version of one manifest.

A write puts the new partitions of a table into a folder of its own. A commit publishes, by one rename, which folder
holds each partition of each table. Readers see the tables of one version; what broke off before its commit is seen by
nobody.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from centflow.sources import files

_PART = "_part"


@dataclass
class Tables:
    """The tables under ``path``: of each its schema and the folder of each partition."""

    spark: SparkSession
    path: str
    number: int = 0
    schemas: dict[str, str] = field(default_factory=dict)
    places: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Tables":
        """The newest version, an empty one if nothing was committed yet."""
        published = [n for n in files.names(spark, f"{path}/manifest") if n.endswith(".json")]
        said = json.loads(files.read_text(spark, f"{path}/manifest/{published[-1]}")) if published else {}
        return cls(spark, path, said.get("number", 0), said.get("schemas", {}), said.get("places", {}))

    def replace(self, table: str, rows: DataFrame, part: Column, parts: set[str]) -> None:
        """Put ``rows``, each in the partition that ``part`` names, in place of the partitions ``parts``."""
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        rows.withColumn(_PART, part.cast("string")).hint("rebalance", _PART).write.partitionBy(_PART).parquet(folder)
        found = [n.partition("=")[2] for n in files.names(self.spark, folder) if n.startswith(f"{_PART}=")]
        old = self.places.get(table, {})
        kept = {p: place for p, place in old.items() if p not in parts}
        self.schemas[table] = rows.schema.json()
        self.places[table] = kept | {p: f"{folder}/{_PART}={p}" for p in found}

    def parts(self, table: str) -> set[str]:
        return set(self.places.get(table, {}))

    def read(self, table: str, parts: set[str] | None = None) -> DataFrame | None:
        """The table, or some of its partitions only; None if it was never written."""
        if table not in self.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(self.schemas[table]))
        places = [place for p, place in sorted(self.places[table].items()) if parts is None or p in parts]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def commit(self) -> None:
        """Publish all replacements since ``open`` as the next version."""
        self.number += 1
        said = {"number": self.number, "schemas": self.schemas, "places": self.places}
        files.publish_text(self.spark, f"{self.path}/manifest/{self.number:012d}.json", json.dumps(said))

    def sweep(self) -> None:
        """Remove what the newest version does not name, for the owner to call when no reader of an older one is left."""
        newest = Tables.open(self.spark, self.path)
        named = {place.rpartition("/")[0] for places in newest.places.values() for place in places.values()}
        for table in newest.schemas:
            for name in files.names(self.spark, f"{self.path}/{table}"):
                if f"{self.path}/{table}/{name}" not in named:
                    files.remove(self.spark, f"{self.path}/{table}/{name}")
        for name in files.names(self.spark, f"{self.path}/manifest"):
            if name < f"{newest.number:012d}":
                files.remove(self.spark, f"{self.path}/manifest/{name}")


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
