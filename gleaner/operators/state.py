"""State of runs as append-only tables: one folder per table, one partition per batch, latest row per key on reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table to (key, whether the first row wins instead of the last, columns).
TABLES = {
    "samples": (("id",), False, "id string, strategy string, payload string, rendered string, total_score double, created_at timestamp"),
    "dropped": (("id",), True, "id string, strategy string, stage string, reason string"),
    "planned": (("id",), True, "id string, strategy string, spec string"),
    "fingerprints": (("hash",), True, "hash string, sample_id string"),
    "minhash_sigs": (("sample_id",), False, "sample_id string, sig string"),
    "embeddings": (("text_hash", "model"), False, "text_hash string, model string, vec array<double>"),
    "scores": (("id", "endpoint"), False, "id string, endpoint string, scores string, total double"),
    "events": ((), False, "t timestamp, id string, strategy string, data string"),
    "pending": (("id",), False, "id string, strategy string, sample string"),
    "kv": (("k",), False, "k string, v string"),
}
TRANSIENT = ("events", "pending")


class IncompatibleState(Exception):
    """The state was written under settings that do not fit."""


def latest(df: DataFrame, keys: tuple[str, ...], first: bool = False, order: str = "batch_id") -> DataFrame:
    """One row per key: the last (or first) batch. Rows are reduced before the shuffle; no key is sorted in a task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    pick = F.min_by if first else F.max_by
    row = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(order, *[F.col(c) for c in rest if dict(df.dtypes)[c] != "map"])).alias("_r"))
    return row.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


class State:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Write a batch; writing the same batch again replaces it, so a repeated run changes nothing."""
        _, _, schema = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self._path(name)}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        """The current rows; an empty table where nothing was written."""
        keys, first, schema = TABLES[name]
        try:
            df = self.spark.read.schema(schema + ", batch_id int").parquet(self._path(name))
            df.limit(0).count()
        except Exception as error:  # a table that has not been written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        return latest(df, keys, first) if keys else df.drop("batch_id")

    def next_batch(self) -> int:
        """A number that no batch of any table has yet, so that runs never replace each other's rows."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/batch_id=*")
        found = path.getFileSystem(conf).globStatus(path)
        numbers = [int(f.getPath().getName().split("=")[1]) for f in (found or [])]
        return max(numbers, default=-1) + 1

    def add(self, name: str, rows: DataFrame) -> None:
        """Append rows as a batch of their own."""
        self.append(name, rows, self.next_batch())

    def terminal(self) -> DataFrame:
        """Ids that need no more work: committed or dropped."""
        return self.read("samples").select("id").union(self.read("dropped").select("id")).distinct()

    def open_specs(self, specs: DataFrame) -> DataFrame:
        return specs.join(self.terminal(), "id", "left_anti")

    def export(self) -> DataFrame:
        """rendered where there is one, else the payload."""
        return self.read("samples").select("id", F.coalesce("rendered", "payload").alias("value"))

    def cleanup(self) -> None:
        """Empty the tables that only serve a run that is under way."""
        for name in TRANSIENT:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def manifest(self) -> dict[str, str]:
        return {r.k: r.v for r in self.read("kv").collect()}

    def check_manifest(self, settings: dict[str, object], batch_id: int, discard: bool = False) -> None:
        """Fail if settings that the state depends on changed; a null seed and seed 0 are different settings."""
        new, old = {k: json.dumps(v, sort_keys=True) for k, v in settings.items()}, self.manifest()
        changed = sorted(k for k in new if k in old and old[k] != new[k])
        if changed and not discard:
            raise IncompatibleState(f"changed since the state was written: {', '.join(changed)}")
        self.append("kv", self.spark.createDataFrame(sorted(new.items()), "k string, v string"), batch_id)
