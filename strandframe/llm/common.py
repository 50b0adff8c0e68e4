"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string")) % n


def held_out(id_col: Column, n: int, r: int) -> Column:
    """True where the id falls in the held-out remainder; a null id never does."""
    return F.coalesce(bucket(id_col, n) == r, F.lit(False))


def per_batch(fn, names: list[str], schema: pa.Schema):
    """A mapInArrow function: fn gets the named columns as Python lists and returns columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = fn(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))
            if cols is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def with_kept(ddl: str, rows: DataFrame) -> StructType:
    """The schema of ``ddl`` and of the struct ``kept`` where ``rows`` have it."""
    schema = StructType.fromDDL(ddl)
    return schema.add(rows.schema["kept"]) if "kept" in rows.columns else schema


def map_texts(docs: DataFrame, run, ddl: str, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """mapInArrow of ``run`` over ``doc_id, text`` and, where columns are to be kept, a struct ``kept`` of them, which run passes on."""
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    return rows.mapInArrow(run, with_kept(ddl, rows))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of y on x; the knots of a step function to interpolate."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, sum of w, first x, last x
    for i in order:
        blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            a = blocks.pop()
            b = blocks[-1]
            b[0] += a[0]
            b[1] += a[1]
            b[3] = a[3]
    xs, ys = [], []
    for s, n, lo, hi in blocks:
        for k in (lo, hi) if hi > lo else (lo,):
            xs.append(k)
            ys.append(s / n)
    return np.array(xs), np.array(ys)
