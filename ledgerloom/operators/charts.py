"""Chart series: validated points for bar, line, pie, scatter and histogram. Nothing is drawn here."""

from __future__ import annotations

from dataclasses import dataclass
from numbers import Number

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("bar", "line", "pie", "scatter", "histogram")


class ChartSpecError(ValueError):
    """The chart doesn't fit the result."""


@dataclass(frozen=True)
class ChartSpec:
    kind: str
    x: str
    y: str | None = None
    color: str | None = None
    title: str = ""


def plot_columns(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as timestamps, for plots; other columns stay."""
    made = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            made[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.DateType):
            made[f.name] = F.col(f.name).cast("timestamp_ntz")
    return df.withColumns(made) if made else df


def series_frame(spec: ChartSpec, df: DataFrame) -> DataFrame:
    """The points of a chart, x, y and color (where the chart has them), as a DataFrame of a result of any size. A y of
    numbers in text is converted; one without any number is refused."""
    if spec.kind not in KINDS:
        raise ChartSpecError(f"unknown chart {spec.kind}")
    named = {k: c for k, c in (("x", spec.x), ("y", spec.y), ("color", spec.color)) if c}
    for c in named.values():
        if c not in df.columns:
            raise ChartSpecError(f"the result has no column {c} (it has {', '.join(df.columns)})")
    if spec.kind != "histogram" and spec.y is None:
        raise ChartSpecError(f"a {spec.kind} chart needs y")
    out = plot_columns(df.select(*[F.col(c).alias(k) for k, c in named.items()]))
    if spec.y is not None and not isinstance(out.schema["y"].dataType, T.NumericType):
        if not isinstance(out.schema["y"].dataType, T.StringType):
            raise ChartSpecError(f"{spec.y} isn't numeric")
        out = out.withColumn("y", F.col("y").try_cast("double"))
        if not out.where("y IS NOT NULL").limit(1).count():
            raise ChartSpecError(f"{spec.y} isn't numeric")
    elif not out.limit(1).count():
        raise ChartSpecError("the result is empty")
    return out.orderBy(F.col("x").asc_nulls_last()) if spec.kind == "line" else out


def series(spec: ChartSpec, columns: list[str], rows: list[tuple]) -> list[dict]:
    if spec.kind not in KINDS:
        raise ChartSpecError(f"unknown chart {spec.kind}")
    if not rows:
        raise ChartSpecError("the result is empty")
    for c in (spec.x, spec.y, spec.color):
        if c is not None and c not in columns:
            raise ChartSpecError(f"the result has no column {c}")
    if spec.kind != "histogram":
        if spec.y is None:
            raise ChartSpecError(f"a {spec.kind} chart needs y")
        y = columns.index(spec.y)
        if any(r[y] is not None and (isinstance(r[y], bool) or not isinstance(r[y], Number)) for r in rows):
            raise ChartSpecError(f"{spec.y} isn't numeric")
    out = [{k: r[columns.index(c)] for k, c in (("x", spec.x), ("y", spec.y), ("color", spec.color)) if c} for r in rows]
    return sorted(out, key=lambda p: (p["x"] is None, p["x"])) if spec.kind == "line" else out


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): rows in ``bins`` equal bins from low to high; outside values go to bins 0 and bins + 1."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
