"""Parquet scans and products.

A product is a Parquet folder plus a contract beside it: schema, row count and an order-free
digest.  The contract is written after the data, so a product without one is incomplete.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sightline.operators.checks import IntegrityError, content_digest


def scan_required(spark: SparkSession, paths: str | list[str], required: list[str], optional: list[str] = ()) -> DataFrame:
    """Only the required columns (and those optional ones that exist) of Parquet paths."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise IntegrityError(f"missing columns {missing}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def scan_partitions(spark: SparkSession, folder: str, column: str, values: list[str] | None = None) -> DataFrame:
    """A partitioned table, read only where the partition column has one of ``values``."""
    df = spark.read.parquet(folder)
    return df if values is None else df.where(F.col(column).isin(values))


def write_product(df: DataFrame, path: str, *, keys: list[str], partition_by: list[str] = (), metadata: dict | None = None, overwrite: bool = False) -> dict:
    """Write rows sorted by key within range partitions, then the contract; returns the contract."""
    spark = df.sparkSession
    watch = Observation()
    # observed above the exchange: finding the ranges runs what is below it once more
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).observe(watch, F.count("*").alias("row_count"))
    writer = out.write.mode("overwrite" if overwrite else "error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    saved = spark.read.parquet(path)
    digest = content_digest(saved, df.columns).first()
    if digest["row_count"] != watch.get["row_count"]:
        raise IntegrityError(f"{path}: {digest['row_count']} rows for {watch.get['row_count']}")
    contract = {"schema": [[f.name, f.dataType.simpleString()] for f in df.schema.fields], "row_count": digest["row_count"], "digest": digest["digest"], "keys": list(keys), "metadata": metadata or {}}
    text = json.dumps(contract, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.contract")
    return contract


def read_product(spark: SparkSession, path: str, *, verify: bool = True) -> DataFrame:
    """A product whose schema (and, if asked, rows and digest) match its contract."""
    contract = json.loads(spark.read.text(f"{path}.contract").first()[0])
    names = [n for n, _ in contract["schema"]]
    df = spark.read.parquet(path).select(*names)
    if [[f.name, f.dataType.simpleString()] for f in df.schema.fields] != contract["schema"]:
        raise IntegrityError(f"{path}: schema differs from its contract")
    if verify:
        found = content_digest(df, names).first()
        if (found["row_count"], found["digest"]) != (contract["row_count"], contract["digest"]):
            raise IntegrityError(f"{path}: content differs from its contract")
    return df


def project_many(df: DataFrame, outputs: dict[str, list[str]], metrics: dict | None = None) -> dict:
    """Several projections of one scan, with metrics of the rows; the scan is kept while they are written."""
    watch = Observation()
    kept = df.observe(watch, F.count("*").alias("row_count"), *[c.alias(n) for n, c in (metrics or {}).items()]).persist()
    try:
        for path, columns in outputs.items():
            kept.select(*columns).write.mode("error").parquet(path)
    finally:
        kept.unpersist()
    return watch.get
