"""Saved data sets in any file system that Spark reaches: versions in folders, and one small file that names the current one.

A save writes a new version beside the others, checks it as it was written, and then renames a new pointer over the old
one. Until that rename readers see the earlier version; a save that fails leaves it as it is.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.validate import validate
from ..plans.schema import Schema, emit_identity_restarts, parse_ddl

_ID = re.compile(r"^[a-z2-7]{12}$")


class DatasetNotFound(KeyError):
    """No data set of that id."""


class LoadError(ValueError):
    """The rows break the schema; the earlier version, if there is one, is as it was."""


@dataclass
class Dataset:
    name: str
    ddl: str
    tables: dict[str, DataFrame]
    id: str = field(default_factory=lambda: "".join(secrets.choice("abcdefghijklmnopqrstuvwxyz234567") for _ in range(12)))
    report: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    created_at: str = field(default_factory=lambda: dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))

    @property
    def schema(self) -> Schema:
        return parse_ddl(self.ddl)

    @property
    def namespace(self) -> str:
        return f"ds_{self.id}"


class Files:
    """The few file operations that a registry needs, by the file system of Spark's own configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, new: str, old: str) -> None:
        """Rename over a file that may be there, in one step."""
        options = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        over = self._jvm.java.lang.reflect.Array.newInstance(options, 1)
        over[0] = options.getEnumConstants()[1]  # OVERWRITE
        at = self._fs.makeQualified(self.path(new)).toUri()
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at, self._conf).rename(self.path(new), self.path(old), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name))) if self.exists(name) else []


class Registry:
    #: Versions of a data set that stay, the current one among them.
    VERSIONS = 2

    def __init__(self, spark: SparkSession, root):
        self.spark, self.root = spark, str(root).rstrip("/")
        self.files = Files(spark, self.root)

    def _dir(self, dataset_id: str) -> str:
        if not _ID.match(dataset_id):
            raise DatasetNotFound(dataset_id)
        return f"{self.root}/{dataset_id}"

    def _version(self, dataset_id: str) -> str:
        pointer = f"{self._dir(dataset_id)}/current"
        if not self.files.exists(pointer):
            raise DatasetNotFound(dataset_id)
        return f"{self._dir(dataset_id)}/{self.files.read(pointer).strip()}"

    def save(self, ds: Dataset, check: bool = False) -> None:
        """Write a version and make it the current one. With check, rows that break the schema raise LoadError."""
        home = self._dir(ds.id)
        name = f"v{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{secrets.token_hex(3)}"
        new = f"{home}/{name}"
        try:
            for t in ds.schema.tables:
                ds.tables[t.name].write.parquet(f"{new}/{t.name}")
            written = {t.name: self.spark.read.parquet(f"{new}/{t.name}") for t in ds.schema.tables}
            if check and not (report := validate(ds.schema, written)).ok:
                raise LoadError(f"{report.summary()}; the version before is unchanged")
            counts = {name: df.count() for name, df in written.items()}
            self.files.write(f"{new}/schema.ddl", ds.ddl)
            manifest = {"id": ds.id, "name": ds.name, "created_at": ds.created_at, "row_counts": counts, "report": ds.report, "params": ds.params, "identity": emit_identity_restarts(ds.schema, written)}
            self.files.write(f"{new}/manifest.json", json.dumps(manifest, indent=2, default=str))
            self.files.write(f"{home}/.{name}", name)
            self.files.replace(f"{home}/.{name}", f"{home}/current")
        except BaseException:
            self.files.delete(new)
            raise
        shown = self.files.read(f"{home}/published") if self.files.exists(f"{home}/published") else ""
        for old in self.versions(ds.id)[: -self.VERSIONS]:
            if old != shown:  # views read it
                self.files.delete(f"{home}/{old}")

    def versions(self, dataset_id: str) -> list[str]:
        """Oldest first."""
        return [x for x in self.files.names(self._dir(dataset_id)) if x.startswith("v")]

    def info(self, dataset_id: str) -> dict:
        try:
            return json.loads(self.files.read(f"{self._version(dataset_id)}/manifest.json"))
        except ValueError as e:
            raise DatasetNotFound(dataset_id) from e

    def list(self) -> list[dict]:
        """Newest first; folders that can't be read are left out."""
        out = []
        for name in self.files.names(self.root):
            try:
                out.append(self.info(name))
            except DatasetNotFound:
                continue
        return sorted(out, key=lambda m: (m["created_at"], m["id"]), reverse=True)

    def load_schema(self, dataset_id: str) -> Schema:
        return parse_ddl(self.files.read(f"{self._version(dataset_id)}/schema.ddl"))

    def load(self, dataset_id: str) -> Dataset:
        m, where = self.info(dataset_id), self._version(dataset_id)
        ddl = self.files.read(f"{where}/schema.ddl")
        tables = {t.name: self.spark.read.parquet(f"{where}/{t.name}") for t in parse_ddl(ddl).tables}
        return Dataset(m["name"], ddl, tables, m["id"], m["report"], m["params"], m["created_at"])

    def delete(self, dataset_id: str) -> bool:
        where = self._dir(dataset_id)
        existed = self.files.exists(where)
        self.files.delete(where)
        self.drop(dataset_id)
        return existed

    def publish(self, ds: Dataset) -> dict[str, int]:
        """Make the current version's tables views of a database of their own; gives the rows of each.

        The version is checked first: rows that break the schema raise LoadError, and the views stay with the version
        that they show. Views of a version before are replaced one by one, each in one step."""
        where = self._version(ds.id)
        schema = self.load_schema(ds.id)
        tables = {t.name: self.spark.read.parquet(f"{where}/{t.name}") for t in schema.tables}
        report = validate(schema, tables)
        if not report.ok:
            raise LoadError(f"{report.summary()}; what was published before is unchanged")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {ds.namespace}")
        for t in schema.tables:
            self.spark.sql(f"CREATE OR REPLACE VIEW {ds.namespace}.`{t.name.lower()}` AS SELECT * FROM parquet.`{where}/{t.name}`")
        self.files.write(f"{self._dir(ds.id)}/published", where.rsplit("/", 1)[1])
        return dict(report.rows)

    def drop(self, dataset_id: str) -> bool:
        existed = self.spark.catalog.databaseExists(f"ds_{dataset_id}")
        self.spark.sql(f"DROP DATABASE IF EXISTS ds_{dataset_id} CASCADE")
        return existed

    def published(self) -> list[str]:
        return sorted(d.name[3:] for d in self.spark.catalog.listDatabases() if d.name.startswith("ds_"))
