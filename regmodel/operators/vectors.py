"""Embeddings, point ids and vector index tables (E)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells

NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the namespace of URLs in RFC 4122


def embed(df: DataFrame, col: str, encoder: Callable[[DataFrame, str], DataFrame] | None = None, dim: int = 64) -> DataFrame:
    """Df and an embedding.  Default: hashed bag of lower-cased tokens, normalised; any other encoder is a function
    (df, col) -> df with the column embedding."""
    if encoder:
        return encoder(df, col)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    counted = HashingTF(numFeatures=dim, inputCol="words_", outputCol="counts_").transform(df.withColumn("words_", words))
    normal = Normalizer(p=2.0, inputCol="counts_", outputCol="unit_").transform(counted)
    return normal.withColumn("embedding", vector_to_array("unit_", "float32")).drop("words_", "counts_", "unit_")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 UUID of a name, by SHA-1 and the version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(df: DataFrame, collection: str, source: str = "source_id", index: str = "source_index", text: str = "text") -> DataFrame:
    """Id from collection, source and index, or from the text where there is no source."""
    name = F.when(F.col(source).isNotNull(), F.concat(F.lit(f"{collection}|"), F.col(source), F.lit("|"), F.col(index).cast("string"))).otherwise(F.col(text))
    return df.withColumn("id", uuid5(name))


def source_index(df: DataFrame, source: str = "source_id", order: str = "ordinal") -> DataFrame:
    """Running index of each chunk within its source, from 0."""
    return df.withColumn("source_index", F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1)


def upsert_by_source(index: DataFrame, new: DataFrame, replace: bool = True, source: str = "source_id", key: str = "id", order: str | None = None) -> DataFrame:
    """All points of the sources in ``new`` are replaced (not so without ``replace``), and all points of the same id.  Of new points of one
    id the last by ``order`` stays, a column of new that says when a point came; without it, or where it is equal, the one with the largest hash."""
    columns = index.columns
    place = [F.desc_nulls_last(order)] if order else []
    last = Window.partitionBy(key).orderBy(*place, F.desc(F.xxhash64(*columns)))
    fresh = new.withColumn("r_", F.row_number().over(last)).where("r_ = 1")
    kept = index.join(new.select(source).where(F.col(source).isNotNull()).distinct(), source, "left_anti") if replace else index
    kept = kept.join(new.select(key).distinct(), key, "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))


def prune_sources(index: DataFrame, keep: list[str] | DataFrame, source: str = "source_id") -> DataFrame:
    """E5: only points of listed sources stay; points without one go.  An empty list is an error."""
    if not isinstance(keep, DataFrame):
        if not keep:
            raise ValueError("nothing to keep: the index would be emptied")
        keep = index.sparkSession.createDataFrame([(k,) for k in keep], "k string")
    elif keep.isEmpty():
        raise ValueError("nothing to keep: the index would be emptied")
    return index.join(keep.toDF("k"), F.col(source) == F.col("k"), "left_semi")


def search(index: DataFrame | cells.Cells, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k points of the largest cosine for each query.  index: id, embedding and more, or its cells (``cells.build``), which can be kept
    for many searches; queries: query_id, embedding.  The filter comes before the ranking.  Ties go to the smaller id."""
    return cells.search(index if isinstance(index, cells.Cells) else cells.build(index), queries, k, where)


def index_info(index: DataFrame, source: str = "source_id") -> DataFrame:
    """Points, vectors and distinct sources; not_found for an empty index."""
    return index.agg(F.count("*").alias("points"), F.count("embedding").alias("vectors"), F.count_distinct(source).alias("sources")).withColumn("status", F.when(F.col("points") > 0, "ok").otherwise("not_found"))
