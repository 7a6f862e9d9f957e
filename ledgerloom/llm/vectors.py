"""Integer vectors, and classes of equal ones with their first members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    return F.coalesce(F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component, in double precision.

    Components stop at the root of ``2**53 / width`` (11 million for 64 of them),
    so that every inner product is exact in double precision.
    """
    most = F.floor(F.sqrt(F.lit(2.0**53) / F.greatest(F.size(vector), F.lit(1))))
    return F.transform(vector, lambda e: F.greatest(-most, F.least(most, F.floor(F.lit(float(factor)) * e.cast("double")))).cast("int"))


def integer_rows(vectors: DataFrame, factor: int, id_col: str, vector_col: str, **further: Column) -> DataFrame:
    """``row, id, *further, v``: the rows with an id and a sound vector, each with a number of its own."""
    keep = vectors.select(F.col(id_col).cast("long").alias("id"), *(c.alias(name) for name, c in further.items()), F.col(vector_col).alias("x")).where(F.col("id").isNotNull() & sound(F.col("x")))
    return keep.select(F.monotonically_increasing_id().alias("row"), "id", *further, scaled(F.col("x"), factor).alias("v"))


def distinct_vectors(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``class_id, first_id, h, *keys, v, members``: a row per distinct keys and vector.

    ``members`` has the ``most`` smallest ids with their rows: no search for fewer
    rows returns another. Spark drops the others before the shuffle.
    """
    hashed = rows.withColumn("h", F.xxhash64(*keys, "v", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("h", *keys, "v").orderBy("id", "row"))
    first = hashed.withColumn("place", place).where(F.col("place") <= most)
    classes = first.groupBy("h", *keys, "v").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
    return classes.select(F.col("members")[0]["row"].alias("class_id"), F.col("members")[0]["id"].alias("first_id"), "h", *keys, "v", "members")


def inner(a: Column | str, b: Column | str) -> Column:
    """The exact inner product of two integer vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, e: s + e)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def merged_members(found: DataFrame, key: list[str], most: int) -> DataFrame:
    """``key..., first``: of the classes found for a key (``score, members``) the ``most`` first rows, as (-score, id, row)."""
    each = F.transform("members", lambda m: F.struct((-F.col("score")).alias("minus"), m["id"].alias("id"), m["row"].alias("row")))
    return found.select(*key, each.alias("each")).groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("each"))), 1, most).alias("first"))
