"""Versions of saved data sets: a save or publication that fails leaves the earlier one."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.registry import Dataset, DatasetNotFound, LoadError, Registry

DDL = "CREATE TABLE p (id SERIAL PRIMARY KEY, name VARCHAR(5) NOT NULL); CREATE TABLE c (id INT PRIMARY KEY, p_id INT NOT NULL REFERENCES p)"


def tables(spark, n, dangling=0):
    return {"p": spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("name")), "c": spark.range(1, 2 * n + 1).select(F.col("id").cast("int").alias("id"), ((F.col("id") - 1) % n + 1 + dangling).cast("int").alias("p_id"))}


def counts(reg, ds):
    return {k: v.count() for k, v in reg.load(ds.id).tables.items()}


def test_a_failed_save_leaves_the_earlier_version(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}/sets")
    ds = Dataset("demo", DDL, tables(spark, 3))
    with pytest.raises(DatasetNotFound):
        reg.info(ds.id)
    reg.save(ds, check=True)
    assert counts(reg, ds) == {"p": 3, "c": 6} and reg.info(ds.id)["identity"] == ['ALTER TABLE "p" ALTER COLUMN "id" RESTART WITH 4']
    ds.tables = tables(spark, 4, dangling=1)
    with pytest.raises(LoadError, match="fk_dangling"):
        reg.save(ds, check=True)
    assert counts(reg, ds) == {"p": 3, "c": 6} and len(reg.versions(ds.id)) == 1
    good = tables(spark, 5)
    ds.tables = {"p": good["p"], "c": good["c"].withColumn("p_id", F.raise_error(F.lit("a task is lost")).cast("int"))}  # half of it is written then
    with pytest.raises(Exception, match="a task is lost"):
        reg.save(ds)
    assert counts(reg, ds) == {"p": 3, "c": 6} and len(reg.versions(ds.id)) == 1
    for n in (5, 6, 7):
        ds.tables = tables(spark, n)
        reg.save(ds)
        assert counts(reg, ds) == {"p": n, "c": 2 * n}
    assert len(reg.versions(ds.id)) == Registry.VERSIONS
    # saved from what it reads itself
    reg.save(reg.load(ds.id))
    assert counts(reg, ds) == {"p": 7, "c": 14}
    assert reg.delete(ds.id) and reg.list() == []


def test_publication(spark, tmp_path):
    reg = Registry(spark, tmp_path / "sets")
    ds = Dataset("demo", DDL, tables(spark, 3))
    reg.save(ds)
    assert reg.publish(ds) == {"p": 3, "c": 6} and reg.published() == [ds.id]
    ds.tables = tables(spark, 4, dangling=1)
    reg.save(ds)
    with pytest.raises(LoadError):
        reg.publish(ds)
    assert spark.table(f"{ds.namespace}.p").count() == 3
    for n in (6, 7, 5):
        ds.tables = tables(spark, n)
        reg.save(ds)
    assert spark.table(f"{ds.namespace}.p").count() == 3  # a version that views read stays
    assert reg.publish(ds)["c"] == 10 == spark.table(f"{ds.namespace}.c").count()
    assert reg.drop(ds.id) and reg.published() == [] and not reg.drop(ds.id)
