"""The relational drop: select and insert over a table, with a log of what was asked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def rewrite(sql: str, style: str) -> str:
    """{} markers in a driver's parameter style."""
    n = -1

    def marker(_):
        nonlocal n
        n += 1
        return {"qmark": "?", "numeric": f":{n + 1}", "named": f":p{n}", "format": "%s", "pyformat": f"%(p{n})s"}[style]

    return re.sub(r"\{\}", marker, sql)


class Table:
    """A named view with select(columns, condition, vals) and insert(vals)."""

    def __init__(self, spark: SparkSession, name: str, df: DataFrame):
        self.spark, self.name, self.df, self.log = spark, name, df, []
        df.createOrReplaceTempView(name)

    def select(self, columns: list[str] | None = None, condition: str | None = None, vals: tuple = ()) -> DataFrame:
        """Rows that meet a condition with {} markers for values."""
        sql = f"SELECT {', '.join(columns) if columns else '*'} FROM {self.name}" + (f" WHERE {rewrite(condition, 'named')}" if condition else "")
        out = self.spark.sql(sql, args={f"p{i}": v for i, v in enumerate(vals)})
        self.log.append((sql, tuple(vals), out.schema.simpleString()))
        return out

    def insert(self, vals: dict) -> DataFrame:
        """The table with one row more; columns not named are null."""
        row = self.spark.createDataFrame([tuple(vals.get(f.name) for f in self.df.schema)], self.df.schema)
        self.df = self.df.unionByName(row)
        self.df.createOrReplaceTempView(self.name)
        self.log.append(("INSERT", tuple(vals.items()), None))
        return self.df
