"""Tables in files: CSV as pages and cells, stores of results and of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 50


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as text, with the file they come from."""
    return spark.read.option("header", header).option("multiLine", True).csv(path).withColumn("_file", F.input_file_name())


def paged_rows(df: DataFrame, order: str, part: str, rows: int = ROWS) -> DataFrame:
    """page_num and text: `rows` rows a page within each part, under a line that names the columns."""
    columns = [c for c in df.columns if c not in (order, part)]
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1)
    line = F.concat_ws("  ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    paged = placed.withColumn("page_num", F.floor(F.col("_n") / rows) + 1).groupBy(part, "page_num")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n")
    return paged.agg(F.concat(F.lit(f"Columns: {', '.join(columns)}\n\n"), body).alias("text"))


def cells(df: DataFrame, key: str) -> DataFrame:
    """key, col, header, value of each cell."""
    columns = [c for c in df.columns if c != key]
    packed = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(key, F.explode(packed).alias("c")).select(key, "c.*")


def appended(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """A stored result with more rows: columns of either, by name."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Declared schemas from JSON: name and fields, each with a type, text unless it says otherwise."""
    kind = "name string, fields array<struct<name:string,type:string,description:string>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.withColumn("fields", F.transform("fields", lambda f: F.struct(F.trim(f["name"]).alias("name"), F.coalesce(f["type"], F.lit("string")).alias("type"), F.coalesce(f["description"], F.lit("")).alias("description"))))
