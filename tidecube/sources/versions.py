"""Tables in versions: what is published is seen whole or not at all, and what did not change is not written again.

A table is a folder. Below data, every write has a folder of its own that is never changed again. Below manifests, each
version has one small file that names the folders of its parts; the one with the largest number is the table. A new version
appears by renaming a finished manifest to the next number, which fails if another writer was first. So a write that breaks
off leaves the table as it was, readers keep the version that they began with, and old versions can be read. This needs a
file system whose rename is one step and does not overwrite (HDFS, local disks; not plain object stores).

A table to which many batches were appended has as many parts; replace(read()) makes them one and keeps the ledger.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "part_"


class Conflict(RuntimeError):
    """Another writer published a version in the meantime."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        """What a glob below the folder finds, as paths below it."""
        at = self._path(*parts)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        depth = len("/".join(parts).split("/"))
        return sorted("/".join(f.getPath().toString().split("/")[-depth:]) for f in found)

    def versions(self) -> list[int]:
        return sorted(int(n.rpartition("/")[2].removesuffix(".json")) for n in self._names("manifests", "[0-9]*.json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, parts (folder by name) and ledger (the last batch taken from each stream) of a version, the newest if
        unset; of no version, version 0 without parts."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "parts": {}, "ledger": {}}
        at = self._path("manifests", f"{known[-1] if version is None else version}.json")
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to, part = self._path("manifests", f"{manifest['version']}.json"), self._path("manifests", f".{uuid.uuid4().hex}")
        out = part.getFileSystem(conf).create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf)
            files.rename(part, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            part.getFileSystem(conf).delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {manifest['version']} of {self.root} is another writer's") from e
            raise
        return manifest["version"]

    def _write(self, df: DataFrame, keys: list[str]) -> dict[str, str]:
        """df in a new folder: its parts' folders by name, one for each combination of keys. Keys stay columns of the files."""
        folder = f"data/{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.root}/{folder}")
            return {"": folder}
        marked = df.withColumns({f"{MARK}{k}": F.col(k) for k in keys}).hint("rebalance", *[F.col(f"{MARK}{k}") for k in keys])
        marked.write.partitionBy(*[f"{MARK}{k}" for k in keys]).parquet(f"{self.root}/{folder}")
        found = self._names(*folder.split("/"), *[f"{MARK}{k}=*" for k in keys])
        return {name.split("/", 2)[2]: name for name in found}

    def _read(self, folders: list[str], schema: str | None) -> DataFrame:
        types = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        if not folders:
            return self.spark.createDataFrame([], types)
        return self.spark.read.schema(types).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """A version, the newest if unset; of it only these parts, of which those that are not there have no rows."""
        known = self.manifest(version)
        return self._read([f for name, f in known["parts"].items() if parts is None or name in parts], known["schema"])

    def replace(self, df: DataFrame, keys: list[str] = []) -> int:
        """df as the whole table; returns the new version's number."""
        last = self.manifest()
        return self._publish({"version": last["version"] + 1, "schema": df.schema.json(), "parts": self._write(df, keys), "ledger": last["ledger"]})

    def taken(self, batch: tuple[str, int]) -> bool:
        """Whether this batch of a stream, or a later one, is in the table."""
        return self.manifest()["ledger"].get(batch[0], -1) >= batch[1]

    def append(self, df: DataFrame, batch: tuple[str, int]) -> bool:
        """df as a part of its own, batch=N. A batch that is in the table already changes nothing."""
        last = self.manifest()
        if last["ledger"].get(batch[0], -1) >= batch[1]:
            return False
        part = {f"batch={batch[1]}": self._write(df, [])[""]}
        self._publish({"version": last["version"] + 1, "schema": last["schema"] or df.schema.json(), "parts": last["parts"] | part, "ledger": last["ledger"] | {batch[0]: batch[1]}})
        return True

    def merge(self, changed: DataFrame, keys: list[str], combine: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> list[str]:
        """Parts that changed has rows of become combine(their rows and changed's); the others stay the files they are. Returns
        the names of the parts that were written. A batch that is in the table already changes nothing.

        Which parts those are is read off the folders that changed is written to first, so changed is computed once.
        """
        last = self.manifest()
        if batch and last["ledger"].get(batch[0], -1) >= batch[1]:
            return []
        fresh = self._write(changed, keys)
        both = self._read([*fresh.values(), *[f for name, f in last["parts"].items() if name in fresh]], changed.schema.json())
        parts = self._write(combine(both), keys)
        ledger = last["ledger"] | ({batch[0]: batch[1]} if batch else {})
        self._publish({"version": last["version"] + 1, "schema": last["schema"] or changed.schema.json(), "parts": last["parts"] | parts, "ledger": ledger})
        return sorted(parts)

    def show(self, name: str, version: int | None = None) -> None:
        """A catalog view of a version that was written whole. Replacing the view is one step, so who reads by name gets the
        version before or this one; a version made by append or merge has several folders and is read by read()."""
        known = self.manifest(version)
        if len({f.split("/")[1] for f in known["parts"].values()}) != 1:
            raise ValueError("only a version that was written whole has a view")
        folder = "/".join(next(iter(known["parts"].values())).split("/")[:2])
        columns = ", ".join(f"`{f['name']}`" for f in json.loads(known["schema"])["fields"])
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{self.root}/{folder}`")

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all manifests but the newest `keep` and the folders that only they name; returns these folders. Folders that no
        manifest names are left, as a writer may be at them. Not to be called while readers of old versions are at work."""
        known = self.versions()
        old, left = known[:-keep], known[-keep:]
        used = {f for v in left for f in self.manifest(v)["parts"].values()}
        gone = sorted({f for v in old for f in self.manifest(v)["parts"].values()} - used)
        for f in [*gone, *[f"manifests/{v}.json" for v in old]]:
            at = self._path(f)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return gone
