"""Shared helpers: the cluster's shared folder, materialised tables, column guards."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import storage

shared_dir = storage.shared_dir
materialize = storage.stored


def table_path(spark: SparkSession, name: str) -> str:
    return storage.new_path(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that clash with nothing (a null text becomes empty)."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


#: log2 of the bits of a membership map: by the number of its keys, 4 MB at most.
LEAST_BITS, MOST_BITS = 16, 25


def map_bits(n: int) -> int:
    """Some 16 bits a key, within the bounds."""
    return min(max(math.ceil(math.log2(max(n, 1))) + 4, LEAST_BITS), MOST_BITS)


def bit_map(hashes: DataFrame, name: str, bits: int) -> np.ndarray:
    """Bytes whose bits are set where a hash of the column has them as its last ``bits`` bits.  At most 2**bits / 64 rows come to the driver."""
    slot = F.col(name).bitwiseAND((1 << bits) - 1)
    rows = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({name} & 63 AS INT))")).alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return words.astype("<i8").view(np.uint8)


def maybe_in(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for all keys of a (stored) table and for few others: it thins out rows before they are shuffled to an exact join.
    A full map thins out nothing, and the join is as exact."""
    bits = map_bits(keys.count())
    packed = keys.sparkSession.sparkContext.broadcast(bit_map(keys.select(F.xxhash64(key).alias("h")), "h", bits))

    @F.pandas_udf(BooleanType())
    def test(slot: pd.Series) -> pd.Series:
        at = slot.to_numpy(np.int64)
        return pd.Series((packed.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return lambda c: test(F.xxhash64(c).bitwiseAND((1 << bits) - 1))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while any(name.lower() == c.lower() for c in df.columns):
        name += "_"
    return name
