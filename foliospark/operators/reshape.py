"""Nested records and flat rows: implode, explode, runs of equal keys, columns of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared field types.
TYPES = {"string": T.StringType(), "date": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def implode(rows: DataFrame, key: str, order: str, scalars: list[str], lists: dict[str, list[str]]) -> DataFrame:
    """One row for each key: of a scalar the first value that isn't empty, of a list the rows with any value, as structs.
    lists: name to columns named name.field."""
    filled = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
    first = [F.min_by(F.when(filled(c).isNotNull(), F.struct(F.lit(0).alias("z"), filled(c).alias("v"))), F.when(filled(c).isNotNull(), F.col(order)))["v"].alias(c) for c in scalars]
    many = []
    for name, fields in lists.items():
        some = F.coalesce(*(filled(f"{name}.{f}") for f in fields)).isNotNull()
        item = F.struct(F.col(order).alias("_o"), *(filled(f"{name}.{f}").alias(f) for f in fields))
        many.append(F.transform(F.sort_array(F.collect_list(F.when(some, item))), lambda x: x.dropFields("_o")).alias(name))
    return rows.groupBy(key).agg(*first, *many)


def explode(df: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Rows as many as the longest list, at least one; scalars on the first, the i-th items on the i-th."""
    n = F.greatest(F.lit(1), *(F.coalesce(F.size(c), F.lit(0)) for c in lists))
    rows = df.withColumn("row", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(key, "row", *(F.when(F.col("row") == 0, F.col(c)).alias(c) for c in scalars), *(F.get(F.col(c), F.col("row")).alias(c) for c in lists))


def islands(df: DataFrame, key: str, order: str) -> DataFrame:
    """block: runs of consecutive rows of equal key, and place: the row's place in its run."""
    w = Window.orderBy(order)
    change = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    marked = df.withColumn("_c", change).withColumn("block", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(order)))


def islands_in(df: DataFrame, part: str, key: str, order: str) -> DataFrame:
    """As islands, within each `part`: the form for large tables."""
    w = Window.partitionBy(part).orderBy(order)
    change = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    marked = df.withColumn("_c", change).withColumn("block", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(part, "block").orderBy(order)))


def schema(spec: list[dict]) -> T.StructType:
    """A declared record as a type: lists of records, records, scalars; nothing declared gives one placeholder."""

    def kind(f: dict) -> T.DataType:
        inner = f.get("properties") or []
        if f["type"] == "list":
            return T.ArrayType(schema(inner) if inner else T.StringType())
        return schema(inner) if f["type"] == "object" else TYPES[f["type"]]

    fields = [T.StructField(f["name"].strip().replace(" ", "_").replace("-", "_"), kind(f)) for f in spec]
    return T.StructType(fields or [T.StructField("_placeholder", T.StringType())])


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
