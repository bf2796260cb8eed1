"""Dumps of tables as CSV, JSON and SQL lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .document import Fragments, join_document


def _blob(name: str) -> Column:
    return F.concat(F.lit("<BLOB:"), F.octet_length(name), F.lit(">"))


def csv_rows(df: DataFrame) -> DataFrame:
    """line: values with commas between; quoted where they hold a comma, quote or line break; null is empty, bytes their length."""

    def cell(name: str, kind: str) -> Column:
        if kind == "binary":
            return F.coalesce(_blob(name), F.lit(""))
        text = F.col(name).cast("string")
        if kind == "string":
            text = F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
        return F.coalesce(text, F.lit(""))

    return df.select(F.concat_ws(",", *[cell(n, k) for n, k in df.dtypes]).alias("line"))


def sql_rows(df: DataFrame, table: str) -> DataFrame:
    """line: an INSERT a row; quotes doubled, bytes shown as X'...'."""

    def cell(name: str, kind: str) -> Column:
        if kind == "binary":
            value = F.when(F.col(name).isNotNull(), F.lit("X'...'"))
        elif kind == "string":
            value = F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("'"))
        else:
            value = F.col(name).cast("string")
        return F.coalesce(value, F.lit("NULL"))

    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *[cell(n, k) for n, k in df.dtypes]), F.lit(");")).alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    """line: an object a row, nulls included, bytes as their length."""
    shown = [(_blob(n) if k == "binary" else F.col(n)).alias(n) for n, k in df.dtypes]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("line"))


def dump(spark: SparkSession, tables: dict[str, DataFrame], path: str, form: str = "csv", limit: int | None = None) -> list[str]:
    """Writes the tables as text, and gives back the warnings about those that failed.

    CSV and SQL: each table's rows under path/<name> as they are partitioned; <name>.header has the table's name, row count and
    columns. JSON: path/dump.json, one document with an object for each table: name, columns, rows and row_count.
    """
    warnings, whole = [], []
    for name, df in tables.items():
        try:
            part = df if limit is None else df.limit(limit)
            lines = {"csv": csv_rows, "json": json_rows, "sql": lambda x, n=name: sql_rows(x, n)}[form](part)
            seen = Observation()  # rows are counted as they are written: a row may have several lines
            counted = lines.observe(seen, F.count(F.lit(1)).alias("n"))
            if form == "json":
                rows = Fragments(counted.withColumnRenamed("line", "value"), f"{path}/dump.json")
                whole += [("," if whole else "") + json.dumps({"name": name, "columns": df.columns})[:-1] + ', "rows": [', rows, f'], "row_count": {seen.get["n"]}}}']
                continue
            counted.write.mode("overwrite").text(f"{path}/{name}")
            n = seen.get["n"]
            mark = "--" if form == "sql" else "#"
            head = f"{mark} Table: {name} ({n} rows)" if n or form != "sql" else f"-- Table: {name} (empty)"
            rows = [head] + ([",".join(df.columns)] if form == "csv" else [])
            spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.header")
        except Exception as e:  # noqa: BLE001  one table's failure must not end the dump
            warnings.append(f"{name}: {e}")
    if form == "json":
        join_document(spark, f"{path}/dump.json", ["[", *whole, "]"])
    return warnings

