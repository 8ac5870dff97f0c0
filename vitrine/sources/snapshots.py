"""Tables that change from one whole snapshot to the next.

Rows lie in buckets of their key's hash. A commit writes the buckets that it touches into a folder of its own, and then
publishes a manifest, which names the folder of every bucket, by one rename that fails where that version exists. Readers
take the newest manifest: they see the table before a commit or after it, never a mix, and a commit that dies leaves
only a folder that no manifest names. Untouched buckets keep their files.

Where two writers meet, the second one's rename fails; it starts again from the other's version. A manifest also keeps the
number of the last batch of each stream, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.registry import as_states, merge_states, state_values

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class SnapshotTable:
    """The table at path, whose rows are dealt to buckets by the column key; the number of buckets is set by its first commit."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._new_buckets = buckets

    # -- manifests

    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        p = self._hadoop().Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        files, p = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the newest; None before the first commit."""
        known = self.versions()
        if not known:
            return None
        files, p = self._at(f"{self.path}/manifests/{known[-1] if version is None else version:020d}.json")
        stream = files.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Puts a manifest in its place by a rename; false where its version is there already."""
        hadoop, gateway = self._hadoop(), self.spark.sparkContext._gateway
        final = f"{self.path}/manifests/{manifest['version']:020d}.json"
        files, draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        files.mkdirs(hadoop.Path(f"{self.path}/manifests"))
        kind = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        to = files.makeQualified(hadoop.Path(final))
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), to, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False
        return True

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(found, found["buckets"])

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{manifest['buckets'][b]}" for b in buckets if b in manifest["buckets"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- commits

    def commit(self, keys: DataFrame, change, stream: str | None = None, batch: int | None = None, tries: int = 5) -> int | None:
        """Replaces the rows of the buckets that hold keys (column key) by change(their rows, or None before the first
        commit). Returns the version, None where nothing is touched or the stream's batch has been committed before."""
        for _ in range(tries):
            base = self.manifest()
            if base and stream is not None and batch is not None and base["streams"].get(stream, -1) >= batch:
                return None
            n = base["n_buckets"] if base else self._new_buckets
            touched = [str(r["bucket"]) for r in keys.select(bucket_of(self.key, n).alias("bucket")).distinct().collect()]  # at most n
            if not touched:
                return None
            version = base["version"] + 1 if base else 0
            rows = change(self._rows(base, touched) if base else None)
            folder = f"data/{version:020d}-{uuid.uuid4().hex}"
            # a bucket is written by one task, as one file or a few; keys are spread over buckets by their hash
            rows.withColumn("bucket", bucket_of(self.key, n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            made = {name.split("=")[1]: f"{folder}/{name}" for name in self._names(f"{self.path}/{folder}") if name.startswith("bucket=")}
            kept = {b: f for b, f in base["buckets"].items() if b not in touched} if base else {}
            streams = dict(base["streams"]) if base else {}
            if stream is not None:
                streams[stream] = batch
            if self._publish({"version": version, "n_buckets": n, "schema": json.loads(rows.schema.json()), "buckets": kept | made, "streams": streams}):
                return version
        raise RuntimeError(f"{tries} commits to {self.path} were overtaken by others")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the versions before the last `keep`, and folders that no kept version names. The folder of a commit that
        may still be published is never one of them: its version is newer than all that are there."""
        known = self.versions()
        gone, kept = known[:-keep], known[-keep:]
        used = {f.split("/")[1] for v in kept for f in self.manifest(v)["buckets"].values()}
        for v in gone:
            files, p = self._at(f"{self.path}/manifests/{v:020d}.json")
            files.delete(p, False)
        for name in self._names(f"{self.path}/data"):
            if kept and int(name.split("-")[0]) <= kept[-1] and name not in used:
                files, p = self._at(f"{self.path}/data/{name}")
                files.delete(p, True)

    # -- the two kinds of writes

    def replace_children(self, children: DataFrame, parents: DataFrame) -> int | None:
        """Replaces all rows of the given parents (the table's key) by children; a parent without new rows loses its old ones,
        those of other parents stay."""
        keys = parents.select(self.key).distinct()

        def change(old: DataFrame | None) -> DataFrame:
            rows = children.join(keys, self.key, "left_semi")
            return rows if old is None else rows.unionByName(old.join(keys, self.key, "left_anti").select(*rows.columns))

        return self.commit(keys, change)

    def merge(self, batch: DataFrame, columns: list[str], sequence: list[str], stream: str | None = None, number: int | None = None) -> int | None:
        """Merges rows by their key: each column takes its non-null value of the greatest sequence (columns of the batch), so
        batches may come in any order, in part twice, and with many rows for one key. values() reads the result."""
        new = as_states(batch, self.key, columns, sequence)
        return self.commit(new, lambda old: new if old is None else merge_states(old, new, self.key, columns), stream, number)

    def values(self, version: int | None = None) -> DataFrame:
        """The merged rows: key and the columns' values."""
        return state_values(self.read(version), self.key)
