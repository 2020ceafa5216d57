"""Embedding near-dedup: lattice hashing on E8.

Each of ``TABLES`` random orthonormal projections maps a unit vector to ``PARTS`` points in
eight dimensions, scaled and decoded to the nearest points of the E8 lattice. A vector enters
the cell of its own points and the ``PROBES - 1`` cells that a single step to a neighbouring
lattice point reaches at least cost. Vectors that share a cell are candidates; a link needs a
cosine of ``THRESHOLD`` or more in double precision.

A cell does not emit its pairs: its members are verified against one leader, components of
those links settle most cells, and in what is open different components meet in blocks. Links
are counted per component. Members within half the angle of the component's first vector are
linked to each other by the triangle inequality on angles, so a large group of near copies is
counted, not compared; the others meet all members of their component in blocks.

At the threshold itself two vectors share a cell with a probability of about 98 %; from 0.92
on more than 99.9 %.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite numbers link with
nothing; vectors of different lengths are never linked; repeated rows are vectors of their
own; NULL identifiers count in n_links and lose against others as component_id; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pricelens.llm.blocks import gathered, meetings_of, paired_blocks
from pricelens.llm.components import components
from pricelens.llm.tables import area, column, compact, table
from pricelens.llm.words import mix
from pricelens.sources.area import StagingArea

THRESHOLD = 0.9
TABLES, PROBES, PARTS = 8, 8, 3
#: Length in the lattice's space, on average, of a distance of 1 between vectors.
SPREAD = 2.15
BLOCK = 1024


# ---------------------------------------------------------------- the lattice


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, then mend the parity where it costs least."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    at = np.abs(rest[odd]).argmax(axis=1)
    near[odd, at] += np.where(rest[odd, at] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the integer points of even sum and the same shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=1)
def e8_neighbours() -> np.ndarray:
    """The 240 steps from a lattice point to its nearest neighbours."""
    steps = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = a, b
            steps.append(step)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    even = (halves < 0).sum(axis=1) % 2 == 0
    return np.concatenate([np.array(steps), halves[even]])


def _projection(dimension: int, table_: int) -> np.ndarray:
    """Orthonormal columns, or rows where the dimension is smaller, scaled to the same spread."""
    rng = np.random.default_rng([dimension, table_])
    width = 8 * PARTS
    draws = rng.normal(size=(max(dimension, width), width))
    return np.linalg.qr(draws)[0][:dimension] * SPREAD * np.sqrt(max(dimension, width) / width)


def cells(units: np.ndarray) -> np.ndarray:
    """One row of ``TABLES * PROBES`` cell names per unit vector."""
    n, dimension = units.shape
    steps = e8_neighbours()
    found = np.zeros((n, TABLES, PROBES), dtype=np.uint64)
    for t in range(TABLES):
        # A cell's name is linear in its coordinates, so a step adds a fixed number to it.
        rng = np.random.default_rng([dimension, t, 1])
        names = rng.integers(1, 2**63, (PARTS, 8), dtype=np.uint64) | np.uint64(1)
        points = (units @ _projection(dimension, t)).reshape(n, PARTS, 8)
        centres = np.stack([nearest_e8(points[:, p]) for p in range(PARTS)], axis=1)
        own = ((2 * centres).astype(np.int64).view(np.uint64) * names).sum(axis=(1, 2))
        gain = ((points - centres) @ steps.T).reshape(n, -1)
        best = np.argpartition(-gain, PROBES - 2, axis=1)[:, : PROBES - 1]
        step_names = ((2 * steps).astype(np.int64).view(np.uint64)[None] * names[:, None]).sum(axis=2)
        found[:, t, 0] = own
        found[:, t, 1:] = own[:, None] + step_names.reshape(-1)[best]
        found[:, t] = mix(found[:, t] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return found.reshape(n, -1).view(np.int64)


# ---------------------------------------------------------------- vectors


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, without NULLs, as double precision."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        sizes = batch.column("size").to_numpy()
        found: list = [None] * batch.num_rows
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            x = _matrix(vectors.take(pa.array(at)))
            valid = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            if not valid.any():
                continue
            for i, row in zip(at[valid], cells(_units(x[valid])), strict=True):
                found[i] = row
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), vectors, pa.array(found, pa.list_(pa.int64()))],
            names=["id", "vector", "cells"],
        )


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row; both have equal lengths in a row, not across rows."""
    sizes = np.array([len(v) for v in a])
    found = np.zeros(len(a))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, y = (_units(_matrix(side.take(pa.array(at)))) for side in (a, b))
        found[at] = (x * y).sum(axis=1)
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = pa.array(_cosines(batch.column("vector"), batch.column("leader_vector")) >= THRESHOLD)
        pair = [batch.column("key").filter(near), batch.column("leader").filter(near)]
        yield pa.RecordBatch.from_arrays(pair, names=["a", "b"])


def _near_matrix(rows: pa.Table) -> np.ndarray:
    """Which open pairs of a meeting are linked."""
    units = _units(_matrix(rows.column("vector").combine_chunks()))
    near = units @ units.T >= THRESHOLD
    np.fill_diagonal(near, False)
    if rows.column("sides")[0].as_py() == 2:
        side = rows.column("side").to_numpy()
        near &= side[:, None] != side[None, :]
    return near


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of a meeting between different components, as many as join them."""
    found: list[tuple[int, int]] = []
    for ended, rows in meetings_of(batches):
        if rows is not None:
            component = rows.column("component").combine_chunks().dictionary_encode()
            component = component.indices.to_numpy()
            near = _near_matrix(rows) & (component[:, None] != component[None, :])
            keys = rows.column("key").to_numpy()
            parent = list(range(component.max() + 1))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
                a, b = root(component[i]), root(component[j])
                if a != b:
                    found.append((int(keys[i]), int(keys[j])))
                    parent[a] = b
        if ended:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"]
            )
            found = []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in meetings_of(batches):
        if rows is not None:
            n = _near_matrix(rows).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("key").combine_chunks(), pa.array(n)], names=["key", "n"]
            )


def _nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a member is within half the threshold's angle of its component's first vector."""
    half_angle = np.sqrt((1 + THRESHOLD) / 2) + 1e-9
    for batch in batches:
        cosines = _cosines(batch.column("vector"), batch.column("first_vector"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("component"), pa.array(cosines < half_angle)],
            names=["key", "component", "outside"],
        )


# ---------------------------------------------------------------- links


def _star_links(
    place: StagingArea, members: DataFrame, vectors: DataFrame, rows: int
) -> DataFrame:
    """Links between the members (bucket, key) of each bucket and its smallest."""
    first = members.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n"))
    pairs = members.join(place.put("leaders", compact(first.where("n > 1"), rows)), "bucket")
    pairs = pairs.where("key <> leader")
    leaders = vectors.select(F.col("key").alias("leader"), F.col("vector").alias("leader_vector"))
    return (
        pairs.select("key", "leader")
        .distinct()
        .join(vectors, "key")
        .join(leaders, "leader")
        .mapInArrow(_verified, "a long, b long")
    )


def linked_vectors(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """(key, id, component, n_links) of every row; a row without links has no component."""
    place = area(spark)
    vector = column("embedding")
    told = embeddings.select(
        column("vec_id").alias("id"),
        vector.alias("vector"),
        # A vector with a NULL in it has no size here, so it gets no cell.
        F.when(F.exists(vector, lambda x: x.isNull()), 0)
        .otherwise(F.coalesce(F.size(vector), F.lit(0)))
        .alias("size"),
    )
    schema = told.select("id", "vector").schema.add("cells", ArrayType(LongType()))
    hashed = told.mapInArrow(_hashed, schema)
    rows = place.put("vectors", hashed.withColumn("key", F.monotonically_increasing_id()))
    vectors = rows.where("cells is not null").select("key", "vector")
    members = place.put(
        "cells",
        rows.select("key", F.explode("cells").alias("bucket")).where("bucket is not null").distinct(),
    )
    n_members, n_rows = members.count(), rows.count()
    links = place.put("star_links", _star_links(place, members, vectors, n_members))
    found = components(spark, links)
    named = members.join(found, F.col("key") == F.col("node"), "left").select(
        "bucket", "key", F.coalesce("component", "key").alias("component")
    )
    named = place.put("named", compact(named, n_members))
    # The leader is the smallest member; what it was not linked to is outside of its component.
    led = named.groupBy("bucket").agg(
        F.min(F.struct("key", "component")).alias("first"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
    )
    still = named.join(place.put("led", compact(led.where("least <> most"), n_members)), "bucket").select(
        "bucket", "key", "component", (F.col("component") != F.col("first.component")).alias("outside")
    )
    meetings = paired_blocks(place.put("open", compact(still, n_members)), ["key", "component"], BLOCK)
    more = gathered(meetings.join(vectors, "key")).mapInArrow(_joining, "a long, b long")
    links = place.put("all_links", links.unionByName(more))
    found = place.put("components", compact(components(spark, links), n_rows))

    of = found.select(F.col("node").alias("key"), "component")
    firsts = vectors.select(F.col("key").alias("component"), F.col("vector").alias("first_vector"))
    inside = (
        of.join(vectors, "key")
        .join(firsts, "component")
        .mapInArrow(_nearness, "key long, component long, outside boolean")
    )
    inside = place.put("inside", inside)
    # Written, like the other aggregates that rows are joined to: a large component can be split.
    close = place.put(
        "close",
        compact(
            inside.where("not outside").groupBy("component").agg(F.count(F.lit(1)).alias("n_close")),
            n_rows,
        ),
    )
    open_ = inside.select(F.col("component").alias("bucket"), "key", "outside")
    meetings = paired_blocks(open_, ["key"], BLOCK)
    counted = gathered(meetings.join(vectors, "key")).mapInArrow(_counts, "key long, n long")
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"))
    n_links = F.coalesce("n", F.lit(0)) + F.when(F.col("outside"), 0).otherwise(F.col("n_close") - 1)
    per_row = inside.join(close, "component").join(counted, "key", "left").select(
        "key", "component", n_links.alias("n_links")
    )
    return (
        rows.select("key", "id")
        .join(per_row, "key", "left")
        .select("key", "id", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def near_vectors(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest linked vec_id), kept."""
    place = area(spark)
    rows = place.put("linked", linked_vectors(spark, embeddings))
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    smallest = place.put("smallest", compact(smallest, rows.count()))
    return rows.join(smallest, "component", "left").select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark, table(spark, folder, "embeddings"))


# All pairs in double precision, and what each vector reaches over them.
OP4_SQL = """
WITH RECURSIVE told AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM told a JOIN told b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT a AS node, a AS seen FROM links
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM told LEFT JOIN least ON vec_id = node LEFT JOIN degree ON vec_id = a
"""
