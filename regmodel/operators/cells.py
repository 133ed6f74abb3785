"""Vector search by cells that reads what can hold one of the nearest, and nothing else."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Points of a cell that one join key holds.
BLOCK = 4096
#: Rows that centroids are fitted on, at most, and how many there may be.
SAMPLE, MOST_CELLS = 20_000, 4096
#: What rounding may add to a cosine that is bounded through angles.
SLACK = 1e-6


@dataclass
class Cells:
    """points: the index with cell_, block_, angle_ (to the cell's centroid) and norm_, stored; centroids: a row each.  Points without a direction
    (null, not finite, all zero, or of another length than the most common one) are in cell -1 and have the cosine 0 to all."""

    points: DataFrame
    centroids: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)


def fit_centroids(index: DataFrame, n_cells: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on at most ``sample`` rows, those of the smallest hashes.  The fit decides how much is read, never what is found."""
    rows = index.where("embedding IS NOT NULL").select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = Counter(len(r[0]) for r in rows).most_common(1)[0][0]
    x, some = _directions(pa.array([r[0] for r in rows], pa.list_(pa.float64())), width)
    x = np.unique(x[some], axis=0)
    if not len(x):
        return np.zeros((0, width))
    at = np.random.default_rng(7).choice(len(x), min(n_cells, len(x)), replace=False)
    centres = x[np.sort(at)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres[centres.any(axis=1)]


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, zero where they are not finite or not as long as ``width``, and whether a row has one."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[fits] = flat.reshape(int(fits.sum()), width)
    out = np.where(np.isfinite(out).all(axis=1, keepdims=True), out, 0)
    return out, out.any(axis=1)


def _directions(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    out, some = _rows(column, width)
    return _unit(out), some


def _norm(vector: str) -> Column:
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n < float("inf"), n).otherwise(0.0)


def build(index: DataFrame, n_cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> Cells:
    """Every row of index (id, embedding and more) in a cell; as many cells as the root of the rows unless given.  A cell is dealt into blocks of
    about ``block`` points, so that no join key holds more however many copies of a point there are."""
    n_cells = n_cells or min(MOST_CELLS, max(1, round(index.count() ** 0.5)))
    centroids = fit_centroids(index, n_cells, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = _directions(batch.column("embedding"), centroids.shape[1])
            cell, angle = np.full(len(x), -1, np.int32), np.zeros(len(x))
            if len(centroids):
                cos = x @ centroids.T
                cell[some] = cos.argmax(axis=1)[some]
                angle[some] = np.arccos(np.clip(cos.max(axis=1), -1, 1))[some]
            yield batch.append_column("cell_", pa.array(cell)).append_column("angle_", pa.array(angle))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    points = stored(index.mapInArrow(run, f"{fields}, cell_ int, angle_ double"), "cell-points")
    blocks = points.groupBy("cell_").agg(F.ceil(F.count("*") / block).alias("blocks_"))  # a row for each cell, of which the parameter allows so many
    points = points.join(F.broadcast(blocks), "cell_").withColumn("block_", F.pmod(F.xxhash64("id"), F.col("blocks_")).cast("int")).withColumn("norm_", _norm("embedding"))
    return Cells(points.drop("blocks_"), centroids)


def probes(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, q_, q_norm_, probes_: for each query its cells from the nearest on, with angle, blocks, the best cosine that a point of the cell can
    have, and whether it is one of the first that together hold k points."""
    of = cells.points.groupBy("cell_").agg(F.count("*").alias("n"), F.min("angle_").alias("lo"), F.max("angle_").alias("hi"), (F.max("block_") + 1).alias("blocks"))
    meta = np.array([tuple(r) for r in of.orderBy("cell_").collect()], float).reshape(-1, 5)
    number, count, lo, hi, blocks = meta.T
    centres, placed = cells.centroids, number >= 0
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("angle", pa.float64()), ("blocks", pa.int32()), ("best", pa.float64()), ("first", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q, some = _directions(part.column(1), centres.shape[1])
                angle, best = np.full((len(q), len(number)), np.pi / 2), np.zeros((len(q), len(number)))
                if placed.any():
                    turned = np.arccos(np.clip(q @ centres[number[placed].astype(int)].T, -1, 1))
                    angle[:, placed] = np.where(some[:, None], turned, np.pi / 2)
                    gap = np.maximum(0, np.maximum(turned - hi[placed], lo[placed] - turned))
                    best[:, placed] = np.where(some[:, None], np.cos(np.minimum(gap, np.pi)), 0)
                order = np.argsort(-best, axis=1, kind="stable")
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(angle, order, 1), axis=1, kind="stable"), 1)
                held = np.cumsum(count[order], axis=1) - count[order]
                pick = lambda a: np.take_along_axis(np.broadcast_to(a, order.shape), order, 1).ravel()
                rows = pa.StructArray.from_arrays([pa.array(pick(number).astype(np.int32)), pa.array(pick(angle)), pa.array(pick(blocks).astype(np.int32)), pa.array(pick(best)), pa.array((held < k).ravel())], fields=list(kind.value_type))
                offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(number))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, rows)], names=["query_id", "q_", "probes_"])

    rows = queries.select("query_id", F.col("embedding").alias("q_"))
    id_type, q_type = (f.dataType.simpleString() for f in rows.schema.fields)
    return rows.mapInArrow(run, f"query_id {id_type}, q_ {q_type}, probes_ array<struct<cell: int, angle: double, blocks: int, best: double, first: boolean>>").withColumn("q_norm_", _norm("q_"))


def _best_of(cell: int, x: pa.Table, q: pa.Table, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of q and scores: for each query the k best of a block.  A product of matrices finds what may be among them; their scores
    are then summed in the order of the numbers, so that equal vectors score alike everywhere and ties are ties."""
    (points, _), (asked, some) = (_rows(t.column(c).combine_chunks(), width) for t, c in ((x, "embedding"), (q, "q_")))
    norm, q_norm, least = (t.column(c).to_numpy() for t, c in ((x, "norm_"), (q, "q_norm_"), (q, "least_")))
    some &= (q_norm > 0) & (cell >= 0)
    place = np.empty(len(norm), np.int64)
    place[pc.sort_indices(x.column("id")).to_numpy()] = np.arange(len(norm))
    unit, q_unit, found = _unit(points), _unit(asked) * some[:, None], []
    for at in range(0, len(q_norm), 256):
        near = unit @ q_unit[at : at + 256].T if cell >= 0 else np.zeros((len(norm), len(q_norm[at : at + 256])))
        cut = least[at : at + 256]
        if len(norm) > k:
            cut = np.maximum(cut, np.partition(near, len(norm) - k, axis=0)[len(norm) - k])
        i, j = np.nonzero(near >= cut - 1e-9)
        score, wanted = np.zeros(len(i)), some[at + j]
        for d in range(width):
            score += points[i, d] * asked[at + j, d]
        score = np.divide(score, norm[i] * q_norm[at + j], out=np.zeros(len(i)), where=wanted)
        order = np.lexsort((place[i], -score, j))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j, side="left")
        found.append((i[rank < k], at + j[rank < k], score[rank < k]))
    found = found or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def search(cells: Cells, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k points of the largest cosine for each query (query_id, embedding; ids are unique), exactly; ties go to the smaller id, and the
    cosine of a vector without a direction is 0.  The nearest cells that hold k points give each query a cosine that k points reach.  Then
    only cells are read whose points' angles to the centroid allow a cosine as large."""
    if where is not None:
        cells = Cells(cells.points.where(where), cells.centroids)
    asked = stored(probes(cells, queries, k), "probes")
    slices = max(1, -(-asked.count() // BLOCK))
    points, width = cells.points, cells.centroids.shape[1]
    plain = [f for f in points.schema.fields if f.name not in ("embedding", "cell_", "block_", "angle_", "norm_")]
    kind = asked.schema["query_id"].dataType.simpleString()
    key = ["cell_", "block_", "slice_"]

    def best(group: tuple, x: pa.Table, q: pa.Table) -> pa.Table:
        i, j, score = _best_of(group[0].as_py(), x, q, width, k)
        return x.select([f.name for f in plain]).take(pa.array(i)).append_column("query_id", q.column("query_id").take(pa.array(j))).append_column("score", pa.array(score))

    def scored(wanted: DataFrame) -> DataFrame:
        """wanted: query_id, q_, q_norm_, least_, p_ (a probe).  Blocks of points meet slices of queries, both of bounded size."""
        q = wanted.withColumn("block_", F.explode(F.sequence(F.lit(0), F.col("p_.blocks") - 1))).withColumn("cell_", F.col("p_.cell")).drop("p_")
        q = q.withColumn("slice_", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
        x = points.join(q.select(*key[:2], F.col("slice_").alias("of_")).distinct(), key[:2])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
        met = lambda g, a, b: best(g, a, b) if a.num_rows and b.num_rows else best(g, a.slice(0, 0), b.slice(0, 0))
        return x.groupBy(*key[:2], "of_").cogroup(q.groupBy(*key)).applyInArrow(met, f"{fields}, query_id {kind}, score double")

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = asked.select("query_id", "q_", "q_norm_", F.lit(-2.0).alias("least_"), F.explode(F.filter("probes_", lambda p: p["first"])).alias("p_"))
    near = stored(top(scored(first)), "nearest-cells")
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least_"))
    rest = asked.join(least, "query_id", "left").withColumn("least_", F.coalesce("least_", F.lit(-2.0)))
    rest = rest.select("query_id", "q_", "q_norm_", "least_", F.explode(F.filter("probes_", lambda p: ~p["first"] & (p["best"] + SLACK >= F.col("least_")))).alias("p_"))
    return top(near.drop("rank").unionByName(scored(rest)))
