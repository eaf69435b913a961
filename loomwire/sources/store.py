"""The store of accepted items: a Parquet table by category, or any JDBC table."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.operators.items import first_wins, upsert
from loomwire.schema import ITEM


class Conflict(RuntimeError):
    """Another writer has put its version of the store in place first."""


class ParquetStore:
    """Items in versions of a folder, each partitioned by category and part of the key; numbered pointers name
    the folders that make up a version.

    An upsert writes only the parts that change, beside the rest in the pointer's list, so a reader never
    sees half a version and no plan reads what it overwrites. A pointer is written aside and renamed to the next number,
    never over another: a crash leaves the version before it, and of two writers the later one
    starts again on the other's version. A key belongs to the whole store: a change of its category
    takes the old row out. ``parts`` bounds what a single change writes again and what one task holds
    of a large category."""

    def __init__(self, spark: SparkSession, root: str, schema=ITEM, parts: int = 16) -> None:
        self.spark, self.root, self.schema, self.parts = spark, root.rstrip("/"), schema, parts

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the current pointer, 0 if there is none."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folders(self, version: int) -> dict[tuple[str, int], str]:
        """Folder of each category and part."""
        if not version:
            return {}
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers/{version}"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        rows = [line.split("\t") for line in text.splitlines() if line]
        return {(c, int(p)): f for c, p, f in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, categories: list[str] | None = None) -> DataFrame:
        return self._read([f for (c, _), f in sorted(self._folders(self.version()).items()) if categories is None or c in categories])

    def upsert(self, changes: DataFrame, attempts: int = 5) -> None:
        """Replaces rows of known hash_ids and adds the others; of several changes the first counts."""
        for left in reversed(range(attempts)):
            try:
                return self._upsert(changes)
            except Conflict:
                if not left:
                    raise

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("hash_id"), F.lit(self.parts)).cast("int")

    def _upsert(self, changes: DataFrame) -> None:
        version = self.version()
        now = self._folders(version)
        new = changes.select(*[c for c in self.schema.names if c in changes.columns]).withColumn("__p", self._part())
        old = self._read(sorted(now.values())).withColumn("__p", self._part())
        moved = old.join(new.select("hash_id"), "hash_id", "left_semi")
        pairs = new.select("category", "__p").unionByName(moved.select("category", "__p")).distinct()
        touched = sorted((r[0], r[1]) for r in pairs.collect())  # categories are few, parts are bounded
        if not touched:
            return
        again = self._read([now[t] for t in touched if t in now])
        merged = upsert(again, new.drop("__p"))
        folder = f"{self.root}/v-{uuid.uuid4().hex[:12]}"
        for_disk = merged.withColumns({"__c": F.col("category"), "__p": self._part()}).repartition("__c", "__p")
        for_disk.write.partitionBy("__c", "__p").parquet(folder)
        jvm, fs = self._fs()
        folders = {k: f for k, f in now.items() if k not in touched}
        for c in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
            name = c.getPath().getName()
            for p in fs.listStatus(c.getPath()) if name.startswith("__c=") else ():
                folders[jvm.java.net.URLDecoder.decode(name[4:], "UTF-8"), int(p.getPath().getName()[4:])] = p.getPath().toString()
        self._point(version + 1, folders)

    def _point(self, version: int, folders: dict[tuple[str, int], str]) -> None:
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        target, aside = path(f"{self.root}/pointers/{version}"), path(f"{self.root}/aside/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(aside, True)
        out.write("".join(f"{c}\t{p}\t{f}\n" for (c, p), f in sorted(folders.items())).encode())
        out.close()
        if fs.exists(target):
            raise Conflict(f"version {version} is there already")
        try:
            # a rename that does not overwrite: it fails if another writer was faster
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            raise Conflict(f"version {version} is there already") from e


class JdbcStore:
    """Items in a database table; reads push their filters down."""

    def __init__(self, spark: SparkSession, url: str, name: str = "brief_news", **options: str) -> None:
        self.spark, self.url, self.name, self.options = spark, url, name, options

    def read(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=self.name, **self.options).load()

    def upsert(self, changes: DataFrame, merge: bool = True) -> None:
        """Writes the changes (the first of each hash_id) to a staging table, which the database then merges
        in one statement. The staging table has a name of its own, so that writers do not meet."""
        staging = f"{self.name}_{uuid.uuid4().hex[:12]}"
        new = first_wins(changes, ["hash_id"], [c for c in ("category", "source_ord", "item_ord") if c in changes.columns])
        new.write.format("jdbc").options(url=self.url, dbtable=staging, **self.options).mode("overwrite").save()
        if merge:
            self.execute(merge_sql(self.name, staging, new.columns))
            self.execute(f"DROP TABLE {staging}")

    def execute(self, statement: str) -> None:
        """One statement over a connection of the session's JDBC driver."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, str(v))
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.createStatement().execute(statement)
        finally:
            connection.close()


def merge_sql(table: str, staging: str, columns: list[str], key: str = "hash_id") -> str:
    """A standard MERGE of ``staging`` into ``table`` by ``key``."""
    others = [c for c in columns if c != key]
    sets = ", ".join(f"{c} = s.{c}" for c in others)
    names, values = ", ".join(columns), ", ".join(f"s.{c}" for c in columns)
    return f"MERGE INTO {table} t USING {staging} s ON t.{key} = s.{key} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
