"""Tables of one folder that change together, bucket by bucket.

Rows lie in buckets by a hash of a key column.  A commit writes the buckets that a batch
touches into new folders and then puts one manifest beside the last, by a rename that
fails if another writer was there first; the manifest names the folders of all tables.
So a reader sees all tables before a batch or all after it, a job that dies leaves what
was there, and a batch that runs again finds itself done.  Folders that the last two
manifests do not name are deleted by the next commit, whoever left them.  A table
doubles its buckets once they are larger than `bucket_bytes` on average.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that a table's folders are dealt by.
BUCKET = "bucket"


#: Bytes that a file holds in memory where a task writes all buckets at once.
OPEN_BYTES = 2_000_000


class Tables:
    """keys: of each table the column whose hash deals its rows; tables "name@1", "name@2", ... are dealt as "name" is."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = 16, bucket_bytes: int = 128 << 20):
        self.spark, self.folder, self.keys, self.buckets, self.bucket_bytes = spark, folder.rstrip("/"), keys, buckets, bucket_bytes
        self._scratch: list[str] = []

    # --- the shared store -------------------------------------------------

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._at(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def _bytes(self, path: str) -> int:
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength()

    # --- manifests ----------------------------------------------------------

    def _manifests(self) -> list[dict]:
        """The last two, the last first; older ones are gone."""
        names = [n for n in self._names("manifest") if n.endswith(".json") and n[0].isdigit()]
        read = lambda n: json.loads(self.spark.read.text(f"{self.folder}/manifest/{n}", wholetext=True).first()[0])
        return [read(n) for n in names[-1:-3:-1]]

    def manifest(self) -> dict:
        """version, batch, numbers, and of each table its schema, its number of buckets and their folders."""
        found = self._manifests()
        return found[0] if found else {"version": 0, "batch": -1, "numbers": {}, "tables": {}}

    def has(self, batch_id: int) -> bool:
        return self.manifest()["batch"] >= batch_id

    def key(self, name: str) -> str:
        return self.keys[name.split("@")[0]]

    def names(self, prefix: str) -> list[str]:
        """The tables "prefix@..." that the last commit left."""
        return sorted(n for n in self.manifest()["tables"] if n.startswith(f"{prefix}@"))

    # --- rows ---------------------------------------------------------------

    def _of(self, name: str, manifest: dict | None = None) -> dict:
        return (manifest or self.manifest())["tables"].get(name, {"buckets": self.buckets, "parts": {}, "schema": None})

    def bucket(self, name: str, key: Column, manifest: dict | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._of(name, manifest)["buckets"])).cast("int")

    def touched(self, name: str, keys: DataFrame, column: str | None = None) -> list[int]:
        """The buckets of a table that keys lie in: as many numbers as it has buckets at most."""
        of = self.bucket(name, F.col(column or self.key(name)))
        return sorted(r[0] for r in keys.select(of.alias(BUCKET)).distinct().collect())

    def read(self, name: str, some: list[int] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets; None before its first commit."""
        t = self._of(name)
        if t["schema"] is None:
            return None
        parts = [f"{self.folder}/{p}/{BUCKET}={b}" for b, p in t["parts"].items() if some is None or int(b) in some]
        return self.spark.read.schema(t["schema"]).parquet(*parts) if parts else self.spark.createDataFrame([], t["schema"])

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once and kept in the folder until the next commit is done."""
        path = f"{self.folder}/scratch/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self._scratch.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_kept(self) -> None:
        for path in self._scratch:
            self._remove(path)
        self._scratch = []

    def _write(self, name: str, rows: DataFrame, buckets: int, dealt: bool = True) -> str:
        path = f"data/{name}-{uuid.uuid4().hex}"
        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key(name)), F.lit(buckets)).cast("int"))
        rows = rows.hint("rebalance", BUCKET) if dealt else rows
        if dealt:
            rows.sortWithinPartitions(BUCKET, self.key(name)).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.folder}/{path}")
            return path
        # a task holds all buckets' files open in small row groups, so its many rows needn't be sorted, which would spill
        conf, writers = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(writers)
        conf.set(writers, str(buckets))
        try:
            rows.write.option("compression", "zstd").option("parquet.block.size", str(OPEN_BYTES)).partitionBy(BUCKET).parquet(f"{self.folder}/{path}")
        finally:
            conf.set(writers, before)
        return path

    def ahead(self, name: str, rows: DataFrame) -> dict:
        """Writes a new table for the next commit, each task its own file of a bucket: for rows that are many and few tasks' own, which no exchange needs to deal.

        What commit() does not take is deleted with the next one.
        """
        path = self._write(name, rows, self.buckets, dealt=False)
        return {"buckets": self.buckets, "parts": self._parts(path), "schema": rows._jdf.schema().toDDL()}

    def rows(self, table: dict) -> DataFrame:
        """The rows of a table written ahead."""
        parts = [f"{self.folder}/{p}/{BUCKET}={b}" for b, p in table["parts"].items()]
        return self.spark.read.schema(table["schema"]).parquet(*parts) if parts else self.spark.createDataFrame([], table["schema"])

    def _parts(self, path: str) -> dict[str, str]:
        return {n.split("=")[1]: path for n in self._names(path) if n.startswith(f"{BUCKET}=")}

    def commit(self, batch_id: int, writes: dict[str, tuple[DataFrame, list[int] | None] | dict | None], numbers: dict | None = None) -> dict:
        """Puts the rows of each table's touched buckets (None: of all) in place of what these held, all tables at once; tables written ahead() come, and those for which nothing is given go.

        Returns how many buckets of each table were written.  Two writers at once: the
        second one's rename fails, and it ends with an error.
        """
        found = self._manifests()
        last = found[0] if found else self.manifest()
        tables, written = dict(last["tables"]), {}
        for name, change in writes.items():
            if change is None:
                tables.pop(name, None)
                continue
            if isinstance(change, dict):
                tables[name], written[name] = change, len(change["parts"])
                continue
            (rows, touched), t = change, self._of(name, last)
            parts = {} if touched is None else {b: p for b, p in t["parts"].items() if int(b) not in touched}
            if touched is None or touched:
                new = self._parts(self._write(name, rows, t["buckets"]))
                parts |= new
                written[name] = len(new)
            tables[name] = {"buckets": t["buckets"], "parts": parts, "schema": rows._jdf.schema().toDDL()}
            while sum(self._bytes(f"{self.folder}/{p}/{BUCKET}={b}") for b, p in parts.items()) > self.bucket_bytes * tables[name]["buckets"]:
                n = tables[name]["buckets"] = 2 * tables[name]["buckets"]
                every = self.spark.read.schema(tables[name]["schema"]).parquet(*[f"{self.folder}/{p}/{BUCKET}={b}" for b, p in parts.items()])
                parts = tables[name]["parts"] = self._parts(self._write(name, every, n))
        manifest = {"version": last["version"] + 1, "batch": batch_id, "numbers": last["numbers"] | (numbers or {}), "tables": tables}
        self._put(manifest)
        self.drop_kept()
        self._tidy([manifest, *found[:1]])
        return written

    def _put(self, manifest: dict) -> None:
        name = f"{manifest['version']:012d}.json"
        fs, at = self._at(f"{self.folder}/manifest/.{name}-{uuid.uuid4().hex}")
        out = fs.create(at, False)
        out.writeBytes(json.dumps(manifest))  # ASCII alone
        out.close()
        to = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{name}")
        if fs.exists(to) or not fs.rename(at, to):
            fs.delete(at, False)
            raise RuntimeError(f"another writer has put manifest {manifest['version']} of {self.folder}")

    def _tidy(self, kept: list[dict]) -> None:
        alive = {p for m in kept for t in m["tables"].values() for p in t["parts"].values()}
        for n in self._names("data"):
            if f"data/{n}" not in alive:
                self._remove(f"{self.folder}/data/{n}")
        for n in self._names("manifest"):
            if n.endswith(".json") and n[0].isdigit() and int(n[:-5]) < kept[-1]["version"]:
                self._remove(f"{self.folder}/manifest/{n}")
