"""Nearest neighbours by exact distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.vectors import DISTANCES, literal

#: About so many queries, and so many rows, meet in one task at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
#: So many distances are held at once.
CELLS = 1 << 21


def nearest(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "l2", ties: list[str] | None = None) -> DataFrame:
    """The ``k`` rows nearest to one vector, with ``distance``. Each task keeps its own k before they meet."""
    out = df.withColumn("distance", DISTANCES[metric](F.col(vector), literal(query)))
    return out.orderBy(F.col("distance").asc_nulls_last(), *(ties or [])).limit(k)


def nearest_of_each(df: DataFrame, queries: DataFrame, vector: str, key: str, query_key: str, k: int, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest rows of each row of ``queries``: (query_id, key, distance, place). Distances of null vectors and of other sizes are null and last, and equal ones go by the key, null last.

    Every row meets every query, in blocks of counted size: a task gets one block of rows and one of queries, and gives on each query's ``k`` nearest
    there. A matrix product finds which rows can be among them, within the bounds of its rounding; their distances are taken as ``DISTANCES`` defines them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector"))
    wanted = queries.select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("_vector"))
    n_rows, n_queries = (max(1, -(-x.count() // size)) for x, size in ((rows, ROW_BLOCK), (wanted, QUERY_BLOCK)))
    block = lambda x, n: F.pmod(F.xxhash64(*x.columns), F.lit(n)).alias
    numbers = lambda n, name: F.broadcast(spark.range(n).select(F.col("id").alias(name)))
    rows = rows.select("*", block(rows, n_rows)("_row_block")).crossJoin(numbers(n_queries, "_query_block"))
    wanted = wanted.select("*", block(wanted, n_queries)("_query_block")).crossJoin(numbers(n_rows, "_row_block"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*wanted.select("query_id").schema, *rows.select(key).schema)) + ", distance double"
    meet = lambda left, right: _nearest_here(left, right, key, k, metric)
    found = rows.groupBy("_row_block", "_query_block").cogroup(wanted.groupBy("_row_block", "_query_block")).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(_ranked(F.col("distance"), metric).asc_nulls_last(), F.col(key).asc_nulls_last())
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _ranked(distance, metric: str):
    """What the order goes by: for l2 the root, in which a few squares fall together."""
    return (F if not isinstance(distance, np.ndarray) else np).sqrt(distance) if metric == "l2" else distance


def _nearest_here(rows: pa.Table, queries: pa.Table, key: str, k: int, metric: str) -> pa.Table:
    """The ``k`` nearest of ``rows`` (key, _vector) to each of ``queries`` (query_id, _vector)."""
    rows = rows.take(pc.sort_indices(rows, [(key, "ascending")], null_placement="at_end"))  # so a row's number ranks its key
    sizes, theirs = _sizes(rows), _sizes(queries)
    at_query, at_row, distances = [], [], []
    for size in np.unique(theirs):
        mine, fit = np.flatnonzero(theirs == size), np.flatnonzero((sizes == size) & (size >= 0))
        if len(fit):
            x = _matrix(rows, fit, size)
            step = max(1, CELLS // len(fit))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                q, r, d = _nearest_of(x, _matrix(queries, part, size), k, metric)
                at_query.append(part[q]), at_row.append(fit[r]), distances.append(d)
        if len(fit) < k:  # the others' distances are null
            others = np.setdiff1d(np.arange(len(sizes)), fit)[: k - len(fit)]
            at_query.append(np.repeat(mine, len(others))), at_row.append(np.tile(others, len(mine))), distances.append(np.full(len(mine) * len(others), None))
    if not at_query:
        at_query, at_row = [np.zeros(0, int)], [np.zeros(0, int)]
    values = pa.chunked_array([pa.array(d, pa.float64(), from_pandas=False) for d in distances], pa.float64())
    return pa.table({"query_id": queries["query_id"].take(pa.array(np.concatenate(at_query))), key: rows[key].take(pa.array(np.concatenate(at_row))), "distance": values})


def _sizes(table: pa.Table) -> np.ndarray:
    """The number of elements of each vector; -1 where it or an element is null."""
    vectors = table["_vector"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
    if vectors.flatten().null_count:
        sizes[np.unique(pc.list_parent_indices(vectors).filter(pc.is_null(vectors.flatten())).to_numpy())] = -1
    return sizes


def _matrix(table: pa.Table, at: np.ndarray, size: int) -> np.ndarray:
    return table["_vector"].combine_chunks().take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)


def _nearest_of(x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` rows of ``x`` nearest to each row of ``q``, equal distances by the row's number."""
    with np.errstate(all="ignore"):
        xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        about = q @ x.T
        unit = 16 * (x.shape[1] + 8) * np.finfo(float).eps
        if metric == "cosine":
            norms = np.sqrt(qq)[:, None] * np.sqrt(xx)
            about, slack = np.where(norms == 0, 1.0, 1 - about / norms), np.full((1, len(x)), unit)
        elif metric == "ip":
            about, slack = -about, unit * (qq[:, None] + xx)
        else:
            about, slack = qq[:, None] + xx - 2 * about, unit * (qq[:, None] + xx)
        # Where squares leave the range in which that bounds the rounding, the row is always looked at.
        plain = [(v == 0) | (v > 1e-100) & (v < 1e100) for v in (xx, qq)]
        zero = [v == 0 for v in (xx, qq)]
        for p, z, v in zip(plain, zero, (x, q)):
            p[z] = ~v[z].any(axis=1)
        sure = plain[1][:, None] & plain[0]
        low = np.where(sure, about - slack, -np.inf)
        if k < len(x):
            first = np.argpartition(low, k - 1, axis=1)[:, :k]
            high = np.where(sure, about + slack, np.inf)
            limit = np.take_along_axis(high, first, axis=1).max(axis=1)
            at_query, at_row = np.nonzero(low <= limit[:, None])
        else:
            at_query, at_row = (a.ravel() for a in np.indices(low.shape))
        distance = np.empty(len(at_query))
        for i in range(0, len(at_query), CELLS >> 3):
            part = slice(i, i + (CELLS >> 3))
            distance[part] = _exact(q[at_query[part]], x[at_row[part]], metric)
        order = np.lexsort((at_row, _ranked(distance, metric), at_query))
    at_query, at_row, distance = at_query[order], at_row[order], distance[order]
    place = np.arange(len(at_query)) - np.searchsorted(at_query, at_query)
    return at_query[place < k], at_row[place < k], distance[place < k]


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The distances of ``DISTANCES`` of each row to its query, added up in the same order."""

    def total(terms: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(x))
        for t in terms:
            out += t
        return out

    columns = range(x.shape[1])
    if metric == "l2":
        return total((x[:, i] - q[:, i]) ** 2 for i in columns)
    product = total(x[:, i] * q[:, i] for i in columns)
    if metric == "ip":
        return -product
    norm = np.sqrt(total(x[:, i] * x[:, i] for i in columns)) * np.sqrt(total(q[:, i] * q[:, i] for i in columns))
    return np.where(norm == 0, 1.0, 1 - product / norm)
