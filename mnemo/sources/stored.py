"""A stored, keyed table: base files in buckets plus delta files, versions that appear whole or not at all.

A version is one JSON file below ``versions`` that names the folders of data it is made of. Writers put
data into a new folder first and then move a finished version file to the next number's name, which
fails if that name is taken: readers see a write wholly or not, and of two writers of one version
the second fails. Rows of the largest ``_seq`` win; a row may say that its key is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has taken this version's number; nothing of the failed write can be seen."""


class StoredTable:
    """``keys`` tell rows apart; ``bucket_by``, which a key determines, says where a row lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._uri = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._uri.getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: Sequence[str], bucket_by: Sequence[str] | None = None, buckets: int = 64) -> StoredTable:
        out = cls(spark, path)
        out._commit(0, {"schema": schema, "keys": list(keys), "bucket_by": list(bucket_by or keys), "buckets": buckets, "base": {}, "deltas": [], "seq": 0})
        return out

    # -- versions --------------------------------------------------------------------------------

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self._at("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> tuple[int, dict]:
        version = max(self.versions()) if version is None else version
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, state: dict) -> int:
        jvm = self.spark._jvm
        partial, final = self._at(f"versions/.{uuid.uuid4().hex}.partial"), self._at(f"versions/{version:012d}.json")
        out = self._fs.create(partial, False)
        out.write(json.dumps(state).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._uri.toUri() if self._uri.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(partial, final, plain)
        except Exception as taken:
            self._fs.delete(partial, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} of {self.path} is taken") from taken
            raise
        return version

    # -- writing ---------------------------------------------------------------------------------

    def bucket(self, state: dict):
        return F.pmod(F.xxhash64(*[F.col(c) for c in state["bucket_by"]]), F.lit(state["buckets"])).cast("int")

    def _put(self, df: DataFrame, state: dict) -> tuple[str, list[int]]:
        """Write rows into a new folder, by bucket; the folder's name and the buckets in it."""
        part = uuid.uuid4().hex
        df.withColumn("bucket", self.bucket(state)).write.partitionBy("bucket").parquet(f"{self.path}/data/part={part}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"data/part={part}"))]
        return part, sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def _delta(self, df: DataFrame, deleted: bool) -> int:
        version, state = self.snapshot()
        seq = state["seq"] + 1
        columns = [f.name for f in self.schema(state).fields]
        rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]).to(self.schema(state))
        part, buckets = self._put(rows.withColumn("_seq", F.lit(seq).cast("long")).withColumn("_deleted", F.lit(deleted)), state)
        state = {**state, "seq": seq, "deltas": [*state["deltas"], {"part": part, "buckets": buckets}]}
        return self._commit(version + 1, state)

    def upsert(self, df: DataFrame) -> int:
        """Write rows over those of the same keys. Keys must be unique in ``df``. Returns the new version."""
        return self._delta(df, False)

    def delete(self, keys: DataFrame) -> int:
        """Delete rows by their keys (and the columns that buckets go by); unknown keys do nothing."""
        return self._delta(keys, True)

    def compact(self, least_deltas: int = 1) -> int:
        """Merge the buckets that at least so many deltas touch into new base files; others are left as they are."""
        version, state = self.snapshot()
        counts: dict[int, int] = {}
        for d in state["deltas"]:
            for b in d["buckets"]:
                counts[b] = counts.get(b, 0) + 1
        touched = sorted(b for b, n in counts.items() if n >= least_deltas)
        if not touched:
            return version
        part, there = self._put(self._merged(state, touched), state)
        base = {k: v for k, v in state["base"].items() if int(k) not in set(touched)} | {str(b): part for b in there}
        deltas = [{**d, "buckets": [b for b in d["buckets"] if b not in set(touched)]} for d in state["deltas"]]
        return self._commit(version + 1, {**state, "base": base, "deltas": [d for d in deltas if d["buckets"]]})

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data that none of the last versions names, failed writes' included; returns the folders deleted.

        Not while a write is under way: its data is named by no version yet.
        """
        versions = self.versions()
        kept: set[tuple[str, int]] = set()
        for v in versions[-keep_versions:]:
            state = self.snapshot(v)[1]
            kept |= {(p, int(b)) for b, p in state["base"].items()} | {(d["part"], b) for d in state["deltas"] for b in d["buckets"]}
        gone = 0
        if self._fs.exists(self._at("data")):
            for part in self._fs.listStatus(self._at("data")):
                name = part.getPath().getName().removeprefix("part=")
                for f in self._fs.listStatus(part.getPath()):
                    b = f.getPath().getName()
                    if b.startswith("bucket=") and (name, int(b.split("=")[1])) not in kept:
                        gone += self._fs.delete(f.getPath(), True)
        for v in versions[:-keep_versions]:
            self._fs.delete(self._at(f"versions/{v:012d}.json"), False)
        return gone

    # -- reading ---------------------------------------------------------------------------------

    @staticmethod
    def schema(state: dict):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(state["schema"])

    def files(self, state: dict, buckets: Sequence[int] | None = None) -> list[str]:
        """The folders that hold the named buckets, or all."""
        wanted = set(buckets) if buckets is not None else None
        take = lambda b: wanted is None or int(b) in wanted
        found = [(p, int(b)) for b, p in state["base"].items() if take(b)] + [(d["part"], b) for d in state["deltas"] for b in d["buckets"] if take(b)]
        return [f"{self.path}/data/part={p}/bucket={b}" for p, b in found]

    def _merged(self, state: dict, buckets: Sequence[int] | None) -> DataFrame:
        schema = self.schema(state).add("_seq", "long").add("_deleted", "boolean")
        paths = self.files(state, buckets)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
        rest = [f.name for f in schema.fields if f.name not in state["keys"]]
        last = rows.groupBy(*state["keys"]).agg(F.max_by(F.struct(*rest), "_seq").alias("r")).select(*state["keys"], "r.*")
        return last.where("NOT _deleted").select(*schema.names)

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version (the latest, or an older one), whole or of some buckets only."""
        state = self.snapshot(version)[1]
        return self._merged(state, buckets).select(*self.schema(state).names)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the bucket's columns lie in: at most as many as there are buckets."""
        state = self.snapshot()[1]
        return sorted(r[0] for r in rows.select(self.bucket(state).alias("b")).distinct().collect())

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the asked-for keys; only their buckets are read."""
        state = self.snapshot()[1]
        return self.read(buckets=self.buckets_of(keys)).join(keys.select(*state["keys"]).distinct(), state["keys"], "left_semi")
