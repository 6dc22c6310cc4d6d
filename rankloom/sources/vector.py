"""Personalisation vectors: any Spark table of (id, v), and a binary format of dense vectors.

Fixed layout, big-endian: int32 class id, int32 length, float64 values; two class ids are in use.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import filesystem, opened

#: The class ids that mark a dense vector, the newer one first.
CLASS_IDS = (1211214, 1140851)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) from a binary vector, or from Parquet or CSV by extension, with columns id and v."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith((".csv", ".csv.gz")):
        df = spark.read.csv(path, header=True, schema="id long, v double")
    else:
        with opened(path) as f:
            head = f.read(8)
            if len(head) < 8 or struct.unpack(">ii", head)[0] not in CLASS_IDS:
                raise ValueError(f"{path} is not a binary vector")
            n = struct.unpack(">ii", head)[1]
            data = f.read(8 * n + 1)
        if len(data) != 8 * n:
            raise ValueError(f"{path} doesn't hold {n} values")
        v = np.frombuffer(data, ">f8").astype(float)
        return spark.createDataFrame(pa.table({"id": pa.array(np.arange(n)), "v": pa.array(v)}))
    return df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("double").alias("v"))


def write_vector(x: DataFrame, path: str) -> None:
    """Write (id, value) with ids 0..n-1 as a binary vector."""
    fs, name = filesystem(path)
    n = x.count()
    with fs.open_output_stream(name, compression=None) as f:
        f.write(struct.pack(">ii", CLASS_IDS[0], n))
        for i, r in enumerate(x.orderBy(x.columns[0]).toLocalIterator()):
            if r[0] != i:
                raise ValueError("ids must be 0 to n-1")
            f.write(struct.pack(">d", r[1]))
