"""From DDL to checked tables: parse, plan, proposals, text pools, rows, validation, with the time of each step."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import consistency, generate
from .operators.plan_check import Override, merge
from .operators.recipes import LEXICON, Recipe, TablePlan
from .operators.validate import Report, validate
from .plans.schema import Schema, parse_ddl

#: Most texts that are asked for a pool; a column with more rows uses them again (numbered, if it is unique).
LARGEST_POOL = 200


class PoolProvider(Protocol):
    """Where texts for a pool come from: anything with this method, a language model's client among them."""

    def texts(self, brief: str, count: int) -> list[str]: ...


class WordPools:
    """Texts from the library's own words, the same for the same brief: pairs of words in permuted order."""

    def texts(self, brief: str, count: int) -> list[str]:
        words = LEXICON["word"]
        start = sum(brief.encode()) % len(words)
        pairs = [f"{a} {b}" for step in range(1, len(words)) for i, a in enumerate(words) for b in [words[(i + step + start) % len(words)]] if a != b]
        return list(dict.fromkeys(pairs))[:count]


@dataclass
class Built:
    schema: Schema
    plans: dict[str, TablePlan]
    tables: dict[str, DataFrame]
    report: Report
    notes: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


def fill_pools(plans: dict[str, TablePlan], schema: Schema, provider: PoolProvider) -> tuple[dict[str, TablePlan], list[str]]:
    """Pools that have a brief and no values get texts of the provider: single blanks, distinct, not longer than the column.
    Where none is left (or the provider fails), the column gets pairs of words, and a note says so."""
    out, notes = {}, []
    for name, p in plans.items():
        columns = dict(p.columns)
        for column, r in p.columns.items():
            if r.kind != "pool" or r.args.get("values") or not r.args.get("brief"):
                continue
            most = schema.table(name).column(column).max_length
            try:
                found = provider.texts(r.args["brief"], max(1, min(p.rows, LARGEST_POOL)))
            except Exception as e:  # whatever a client raises: a pool is never worth the whole data set
                found, said = [], str(e)
                notes.append(f"{name}.{column}: no texts ({said})")
            values = [v for v in dict.fromkeys(" ".join(str(x).split()) for x in found) if v and (most is None or len(v) <= most)]
            if not values:
                notes.append(f"{name}.{column}: pairs of words instead of {r.args['brief']!r}")
            made = {**r.args, "values": values} if values else {"template": "{faker:word} {faker:word}", "unique": r.args.get("unique", False)}
            columns[column] = Recipe("pool" if values else "pattern", made, r.null_ratio)
        out[name] = replace(p, columns=columns)
    return out, notes


def build(spark: SparkSession, ddl: str, rows: int | dict[str, int] = 100, *, seed: int = 0, overrides: Iterable[Override] = (), provider: PoolProvider | None = None, progress: Callable[[str], None] = lambda step: None) -> Built:
    """A data set from its DDL. Faults of the DDL and plans that can't be made raise; rejected proposals and pools without
    texts become notes; broken rules and relations are in the report."""
    seconds: dict[str, float] = {}
    clock = time.perf_counter()

    def done(step: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        seconds[step], clock = round(now - clock, 3), now

    progress("parse")
    schema = parse_ddl(ddl)
    notes = [f"schema: {n}" for n in schema.notes]
    done("parse")
    progress("plan")
    plans, told = merge(generate.plan(schema, rows), overrides, schema)
    notes += told
    done("plan")
    progress("pools")
    plans, told = fill_pools(plans, schema, provider or WordPools())
    notes += told
    done("pools")
    progress("rows")
    tables = generate.expand(spark, schema, plans, seed)
    done("rows")
    progress("check")
    report = validate(schema, tables, expected_rows={p.table: p.rows for p in plans.values()})
    relations = consistency.check(schema, plans, tables)
    for r in relations.where(F.col("violations") > 0).collect() if relations is not None else ():  # a row for each relation
        report.issues.append({**r.asDict(), "examples": []})
    done("check")
    return Built(schema, plans, tables, report, notes, seconds)
