"""Result tables as CSV, JSON and Markdown. Results are small: cells of studies, not bars."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A folder with a header in each file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """Rows of a written table; a missing optional one is empty."""
    if not required and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, columns: Iterable[str] | None = None, decimals: Mapping[str, int] | None = None, titles: Mapping[str, str] | None = None) -> str:
    """A table of all rows, doubles with as many decimals as asked for (3)."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    cells = [F.format_number(c, (decimals or {}).get(c, 3)) if kinds[c] == "double" else F.col(c).cast("string") for c in names]
    rows = df.select(*[F.coalesce(x, F.lit("-")).alias(f"_{i}") for i, x in enumerate(cells)]).collect()
    shown = [(titles or {}).get(c, c) for c in names]
    lines = [shown, ["---"] * len(names), *([str(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_report(path: str, title: str, sections: Mapping[str, str]) -> None:
    """A Markdown file on the driver's disk."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    body = "\n\n".join(f"## {k}\n\n{v}" for k, v in sections.items())
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n{body}\n")


def show_bars(df: DataFrame, begin: int = 500, end: int = 510, columns: Iterable[str] | None = None) -> None:
    """Some bars with all intermediate values, for a check by hand."""
    df.where((F.col("bar_index") >= begin) & (F.col("bar_index") < end)).select(*(columns or df.columns)).orderBy("symbol", "bar_index").show(end - begin, truncate=False)
