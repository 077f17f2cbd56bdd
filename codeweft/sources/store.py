"""A store of tables in partitions by a key: partitions are replaced whole, versions are published at once.

Below its folder:

- `data/<table>/piece=<write>-<n>/`: the rows of some keys, dealt by a hash over `PIECES` folders, as one write left
  them; never changed later. Each row names its key.
- `manifests/<write>/`: which piece holds each key of the tables of a version, as a table.
- `versions/<number>`: the name of a version's manifest, put in place by one create that fails if the
  number is taken. There is no moment without a current version and none with half of one.

A writer starts from the versions it finds and takes the next number; if another writer took it first, it
gets a `Conflict` and nothing it wrote is seen. A reader names a version, or takes the latest, and stays
with it: its scan is joined with the manifest by piece and key; the pieces prune the folders at run time. Keys
that a version does not replace keep their very files. So a write makes a bounded number of folders, however many
keys it has; rows of a replaced key stay in its old piece, unseen, while other keys of that piece are in use. Batches of a stream are known by number: one that
was merged before changes nothing.

A number that a writer took without finishing is passed over by readers and writers alike. A null key is a
key of its own. How atomic the create is depends on the file system; on HDFS and object stores with
conditional writes it is exclusive. Old pieces stay until `vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, key string, piece string"
#: Rows of a manifest with this table name hold the last batch merged of each stream.
BATCHES = "\x00batches"
#: How many folders the keys of one table are dealt over in one write, and the column of its files that names the key.
PIECES, KEY = 64, "__key"


class Conflict(Exception):
    """Another writer published first."""


def token(key: str | Column) -> Column:
    """A key as text; null differs from every other."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(""))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        files, path = self._path("versions")
        files.mkdirs(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> dict[int, str]:
        """The manifests of all numbers taken, empty where a writer did not finish."""
        files, path = self._path("versions")
        taken = {int(f.getPath().getName()): "" for f in files.listStatus(path)}
        if not taken:
            return taken
        named = self.spark.read.text(f"{self.root}/versions").select("_metadata.file_name", "value").collect()  # a few bytes a version
        return taken | {int(number): name for number, name in named}

    def version(self) -> int:
        """The latest version, or 0."""
        return max((n for n, name in self._numbers().items() if name), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(table, key, piece) of a version, the latest if none is named."""
        names = {n: name for n, name in self._numbers().items() if name}
        version = max(names, default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{names[version]}")

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        pieces = self.manifest(version).where(F.col("table") == table).select("piece", F.col("key").alias(KEY))
        if not self._path(f"data/{table}")[0].exists(self._path(f"data/{table}")[1]):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, {KEY} string, piece string").parquet(f"{self.root}/data/{table}")
        return rows.join(pieces, ["piece", KEY]).drop("piece", KEY)

    def _write(self, tables: dict[str, DataFrame], key: str) -> tuple[str, DataFrame]:
        """Writes the rows below a name of their own; the name, and the pieces they became."""
        name, pieces = uuid.uuid4().hex, self.spark.createDataFrame([], MANIFEST)
        for table, rows in tables.items():
            piece = F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64(KEY), F.lit(PIECES)).cast("string"))
            # Large pieces are split over files and small ones share a task.
            rows.withColumn(KEY, token(key)).withColumn("piece", piece).hint("rebalance", "piece").write.partitionBy("piece").mode("append").parquet(f"{self.root}/data/{table}")
            files, path = self._path(f"data/{table}/piece={name}-*")
            if not files.globStatus(path):
                continue  # no rows
            here = self.spark.read.schema(f"{KEY} string, piece string").option("basePath", f"{self.root}/data/{table}").parquet(f"{self.root}/data/{table}/piece={name}-*")
            pieces = pieces.unionByName(here.select(F.lit(table).alias("table"), F.col(KEY).alias("key"), "piece").distinct())
        return name, pieces

    def _publish(self, taken: set[int], name: str, manifest: DataFrame) -> int:
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        number = max(taken, default=0) + 1
        files, path = self._path(f"versions/{number:020d}")
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
                raise Conflict(f"version {number} was published by another writer") from error
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return number

    def publish(self, tables: dict[str, DataFrame], key: str) -> int:
        """A full rebuild: a version that holds these tables and nothing else."""
        taken = set(self._numbers())
        return self._publish(taken, *self._write(tables, key))

    def replace(self, tables: dict[str, DataFrame], key: str, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """A version in which the keys among the rows of each table, and those of `gone` (key), have these rows only."""
        numbers = self._numbers()
        before = max((n for n, name in numbers.items() if name), default=0)
        old = self.manifest(before)
        name, pieces = self._write(tables, key)
        replaced = pieces.select("table", "key")
        if gone is not None:
            names = F.array(*[F.lit(t) for t in tables])
            replaced = replaced.unionByName(gone.select(F.explode(names).alias("table"), token("key").alias("key")))
        if batch is not None:
            mark = self.spark.createDataFrame([(BATCHES, batch[0], str(batch[1]))], MANIFEST)
            pieces, replaced = pieces.unionByName(mark), replaced.unionByName(mark.select("table", "key"))
        return self._publish(set(numbers), name, old.join(replaced.distinct(), ["table", "key"], "left_anti").unionByName(pieces))

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that was merged, or -1."""
        row = self.manifest().where((F.col("table") == BATCHES) & (F.col("key") == stream)).first()
        return int(row.piece) if row else -1

    def merge(self, table: str, schema: str, rows: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int | None:
        """Upserts rows: the partitions they touch become combine(their rows now, new rows). None for a batch merged before."""
        if batch is not None and self.last_batch(batch[0]) >= batch[1]:
            return None
        touched = rows.select(key).distinct()
        now = self.read(table, schema)
        now = now.join(touched.select(F.col(key).alias("__touched")), now[key].eqNullSafe(F.col("__touched")), "left_semi")
        return self.replace({table: combine(now, rows).select(*[c.strip().split(" ")[0] for c in schema.split(",")])}, key, batch=batch)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last `keep` versions names; how many. Not while older versions are read."""
        kept = sorted((n for n, name in self._numbers().items() if name), reverse=True)[:keep]
        named = self.spark.createDataFrame([], "piece string")
        for version in kept:
            named = named.unionByName(self.manifest(version).select("piece"))
        gone, (files, data) = 0, self._path("data")
        if not files.exists(data):
            return 0
        for table in files.listStatus(data):
            there = [f.getPath() for f in files.listStatus(table.getPath()) if f.getPath().getName().startswith("piece=")]
            names = self.spark.createDataFrame([(p.getName()[len("piece=") :],) for p in there], "piece string")
            stale = {r.piece for r in names.join(named.distinct(), "piece", "left_anti").collect()}
            for path in there:
                if path.getName()[len("piece=") :] in stale:
                    files.delete(path, True)
                    gone += 1
        return gone


def newest(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """New rows take the place of those with equal keys."""
    return lambda now, rows: now.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*now.columns))


def added(keys: list[str], value: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Values of equal keys are summed."""
    return lambda now, rows: now.unionByName(rows.select(*now.columns)).groupBy(*keys).agg(F.sum(value).alias(value))
