"""Typed CSV: every value quoted, null an unquoted empty field, ZIP bundles."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import Schema, Table


class CsvFormatError(ValueError):
    """The file doesn't fit the table."""


def formatted(c: Col, kind: T.DataType) -> Col:
    """A value as text: true/false, fixed-point decimals, ISO dates, seconds; NaN is null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def csv_lines(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(line): one CSV line per row, without the header."""
    names = names or df.columns
    have = {c.lower(): c for c in df.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise CsvFormatError(f"missing columns: {', '.join(missing)}")
    fields = [F.coalesce(F.concat(F.lit('"'), F.replace(formatted(F.col(have[n.lower()]), df.schema[have[n.lower()]].dataType), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for n in names]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def header(names: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' for n in names)


def write_csv(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A folder of CSV files, each with the header, written in parallel."""
    lines = csv_lines(df, names)
    top = header(names or df.columns)
    if df.isEmpty():
        lines.sparkSession.range(1).select(F.lit(top).alias("line")).coalesce(1).write.text(path)
        return
    # the number of a row in its task, which writes a file of its own
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines.select(F.when(row == 0, F.concat(F.lit(top + "\n"), F.col("line"))).otherwise(F.col("line")).alias("line")).write.text(path)


def flag(text: Col) -> Col:
    """A boolean from true, t, 1, yes, y or false, f, 0, no, n in any case; blank is null, any other text fails."""
    word = F.lower(F.trim(text))
    bad = F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean")
    return F.when(word.isin("true", "t", "1", "yes", "y"), True).when(word.isin("false", "f", "0", "no", "n"), False).when(F.length(word) > 0, bad)


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A typed table. The header must have the table's columns in order, in any case; a bad value or row fails."""
    first = spark.read.option("multiLine", True).option("escape", '"').option("header", False).csv(path).limit(1).collect()
    found = [x or "" for x in first[0]] if first else []
    if [x.lower() for x in found] != [n.lower() for n in table.names]:
        raise CsvFormatError(f"header {found} isn't {table.names}")
    flags = [f.name for f in table.struct().fields if isinstance(f.dataType, T.BooleanType)]  # Spark's reader knows true and false only
    read = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in flags else f.dataType) for f in table.struct().fields]))
    rows = read.options(header=True, enforceSchema=True, mode="FAILFAST", multiLine=True, escape='"', nullValue="", emptyValue="").csv(path)
    return rows.withColumns({name: flag(F.col(name)) for name in flags})


def write_zip(tables: dict[str, DataFrame], schema: Schema, ddl: str, manifest: dict, path: str) -> None:
    """One CSV per table with schema.ddl and manifest.json; rows stream through the driver, a partition at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for t in schema.tables:
            with out.open(f"{t.name}.csv", "w") as f:
                f.write((header(t.names) + "\n").encode())
                for r in csv_lines(tables[t.name], t.names).toLocalIterator():
                    f.write((r["line"] + "\n").encode())
        out.writestr("schema.ddl", ddl)
        out.writestr("manifest.json", json.dumps(manifest, indent=2, default=str))


def csv_filename(name: str, table: str) -> str:
    return f"{name}_{table}.csv"


def zip_filename(name: str, dataset_id: str) -> str:
    return f"{name}_{dataset_id}.zip"
