"""Batch readers and the schema catalogue."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTable(FileNotFoundError):
    """A reference table is not there; the message says what makes it."""


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV or Parquet by extension; CSV needs a schema, so that nothing is inferred."""
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def load_reference(spark: SparkSession, dimension: str, baseline: str) -> tuple[DataFrame, DataFrame]:
    """Dimension and baseline with the columns the job uses."""
    found = []
    for path, columns in ((dimension, ["building_id", "site_id", "primary_use", "square_feet"]), (baseline, ["building_id", "meter_type", "baseline_p75", "baseline_iqr"])):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise MissingTable(f"{path} is missing: wattline.operators.prepare.prepare() makes it")
        found.append(spark.read.parquet(path).select(*columns))
    return found[0], found[1]


def read_excel(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A spreadsheet as a table, where pandas has an engine for it; a sheet, of a million rows at the most, passes the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path), schema)


def read_sql(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**sql_options(url, query, partition), **options).load()


def sql_options(url: str, query: str, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of a read over JDBC; with ``partition`` (column, low, high, parts) it runs in parts."""
    options = {"url": url, ("dbtable" if partition else "query"): f"({query}) as q" if partition else query}
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return options


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, one row a table: (table_name, row_count)."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


class SchemaCatalog:
    """Schemas by id and by name, kept in a JSON file; what has been registered never changes."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.versions: dict[str, list[int]] = {}
        self.schemas: dict[int, str] = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                saved = json.load(file)
            self.versions = saved["versions"]
            self.schemas = {int(k): v for k, v in saved["schemas"].items()}

    def latest(self, name: str) -> tuple[int, dict]:
        if name not in self.versions:
            raise KeyError(f"no schema named {name}")
        number = self.versions[name][-1]
        return number, json.loads(self.schemas[number])

    def by_id(self, number: int) -> dict:
        if number not in self.schemas:
            raise KeyError(f"no schema with id {number}")
        return json.loads(self.schemas[number])

    def all_of(self, name: str) -> dict[int, dict]:
        """Every version of a schema by its id."""
        return {number: self.by_id(number) for number in self.versions.get(name, [])}

    def register(self, name: str, schema: dict) -> tuple[int, bool]:
        """Find or create a version: its id, and whether it is new. Later versions must follow the rules of governance."""
        from wattline.operators.governance import check_evolution

        text = json.dumps(schema, sort_keys=False)
        for number in self.versions.get(name, []):
            if self.schemas[number] == text:
                return number, False
        for number in self.versions.get(name, []):
            check_evolution(json.loads(self.schemas[number]), schema)
        number = max(self.schemas, default=0) + 1
        self.schemas[number] = text
        self.versions.setdefault(name, []).append(number)
        if self.path:
            with open(f"{self.path}.new", "w", encoding="utf-8") as file:
                json.dump({"versions": self.versions, "schemas": self.schemas}, file)
            os.replace(f"{self.path}.new", self.path)
        return number, True
