"""All documents whose vectors are alike (J7), by an exact threshold join over cells of pivots.

Vectors are scaled to length one, where a cosine of at least c is a distance of at most r = sqrt(2 - 2c).
A few vectors serve as pivots; each vector lives in the cell of its nearest one and visits another cell only
if a vector there can be within r: it may not lie further than r beyond the plane between the two pivots, nor
further than r outside the ring of distances that the cell fills. Each pair is looked for once, in the
cell of the later pivot. Cells are dealt out in blocks, and a task compares two blocks by one matrix
product, so a crowded cell is many tasks of bounded size. Any choice of pivots gives the same rows; vectors
that are spread out in very many dimensions visit most cells, whatever the pivots.

Equal vectors are one class. What is written is linear in the documents: links leave a task as counts and
as a spanning star of what it found connected. `neighbour_pairs` lists the links themselves, between classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paperloom.operators.graph import connected
from paperloom.operators.keys import HOT_ROWS, join_groups
from paperloom.session import cut

PIVOTS = 128
BLOCK_ROWS = 2048
VISIT_VALUES = 1 << 21  # components of the visiting rows that a task holds at once: 16 MB
#: Rounding: a cosine this little below the minimum counts, and bounds are wider by more than it can matter.
_ROUNDING, _SLACK = 1e-12, 1e-5
_KEYS = ["_a", "_b"]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != (width or sizes[0])).any():
        raise ValueError("vectors differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(sizes), width or (sizes[0] if len(sizes) else 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # keeps squares in range
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _usable(vector: str) -> F.Column:
    """Vectors that have a direction: not null or empty, all components finite, one not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _classes(df: DataFrame, doc: str, vector: str) -> DataFrame:
    """Rows (_a, _b, node, n, vector): each different vector once, under its least document."""
    rows = df.filter(_usable(vector) & F.col(doc).isNotNull()).select(
        F.col(doc).alias("node"), F.col(vector).cast("array<double>").alias("vector")
    )
    keyed = rows.select(F.xxhash64("vector").alias("_a"), F.xxhash64(F.lit(1), "vector").alias("_b"), "node", "vector")
    return keyed.groupBy(*_KEYS).agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")
    )


def _homes(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`classes` with unit vectors, the cell of the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector"), pivots.shape[1]))
            square = np.maximum(2 - 2 * unit @ pivots.T, 0)
            cell = square.argmin(1)
            away = np.sqrt(square[np.arange(len(cell)), cell])
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(len(unit) + 1) * pivots.shape[1], pa.int32()), pa.array(unit.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("n"), vectors, pa.array(cell, pa.int32()), pa.array(away)],
                ["node", "n", "vector", "cell", "away"],
            )

    kind = classes.schema["node"].dataType.simpleString()
    ddl = f"node {kind}, n long, vector array<double>, cell int, away double"
    return classes.select("node", "n", "vector").mapInArrow(run, ddl)


def _visits(homes: DataFrame, pivots: np.ndarray, rings: np.ndarray, radius: float) -> DataFrame:
    """Rows (node, n, vector, cell): the later cells that may hold a vector within `radius`. `rings` has the least
    and largest distance from its pivot of each cell's vectors (infinite and -1 where it has none)."""
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    later = np.arange(len(pivots))

    # a row may visit all cells: what is held at once is bounded, whatever the size of Spark's batches
    step = max(VISIT_VALUES // pivots.size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            square = np.maximum(2 - 2 * _matrix(batch.column("vector"), pivots.shape[1]) @ pivots.T, 0)
            own = batch.column("cell").to_numpy()
            beyond = square - square[np.arange(len(own)), own][:, None]
            away = np.sqrt(square)
            near = (beyond <= 2 * radius * between[own] + _SLACK) & (later[None, :] > own[:, None])
            near &= (away <= rings[1] + radius + _SLACK) & (away >= rings[0] - radius - _SLACK)
            row, cell = np.nonzero(near)
            kept = batch.select(["node", "n", "vector"]).take(pa.array(row))
            yield kept.append_column("cell", pa.array(cell, pa.int32()))

    kind = homes.schema["node"].dataType.simpleString()
    rows = homes.select("node", "n", "vector", "cell")
    return rows.mapInArrow(run, f"node {kind}, n long, vector array<double>, cell int")


def _meetings(classes: DataFrame, minimum: float, pivots: int, block_rows: int) -> DataFrame | None:
    """Rows (cell, i, j, first, node, n, vector): the two blocks that task (cell, i, j) compares, `first` telling
    which of them; a block that meets itself has only first rows. None without any vector."""
    # a bounded choice that does not depend on partitions; it decides about speed alone
    chosen = classes.orderBy("_a", "_b").limit(pivots).select("vector").toArrow().column("vector")
    if not len(chosen):
        return None
    centres = _unit(_matrix(chosen))
    radius = float(np.sqrt(2 - 2 * minimum))
    homes = cut(_homes(classes, centres))
    rings = np.array([[np.inf] * len(centres), [-1.0] * len(centres)])
    for r in homes.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect():
        rings[:, r["cell"]] = r["low"], r["high"]
    visits = cut(_visits(homes, centres, rings, radius))
    # at most one row per pivot
    count = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    blocks = count(homes, "_home").join(count(visits, "_visit"), "cell", "left").na.fill(0, ["_visit"])
    blocks = F.broadcast(cut(blocks))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    keep = ["node", "n", "vector"]
    at_home = homes.select("cell", *keep).join(blocks, "cell").withColumn("own", deal("_home"))
    # home blocks are numbered from 0, visiting ones go on behind them
    own = F.col("own")
    meeting = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.alias("first"))
    partners = F.concat(
        F.transform(upto("_home"), lambda b: meeting(F.least(b, own), F.greatest(b, own), own <= b)),
        F.transform(upto("_visit"), lambda b: meeting(own, F.col("_home") + b, F.lit(True))),
    )
    at_home = at_home.select("cell", *keep, F.explode(partners).alias("_m"))
    away = visits.join(blocks, "cell").withColumn("own", F.col("_home") + deal("_visit"))
    meets = F.transform(upto("_home"), lambda b: meeting(b, own, F.lit(False)))
    away = away.select("cell", *keep, F.explode(meets).alias("_m"))
    return at_home.unionByName(away).select("cell", "_m.*", *keep)


def _compared(
    meetings: DataFrame, minimum: float, found: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table], ddl: str
) -> DataFrame:
    """`found(left, right, alike, cosines)` of every two blocks that meet; in a block that meets itself each pair
    of vectors is alike once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = table.column("first")
        left, right = table.filter(first), table.filter(pc.invert(first))
        alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if alone:
            right = left
        if not (left.num_rows and right.num_rows):
            return found(left, right, *[np.zeros((left.num_rows, right.num_rows), t) for t in (bool, float)])
        cosines = _matrix(left.column("vector")) @ _matrix(right.column("vector")).T
        alike = cosines >= minimum - _ROUNDING
        return found(left, right, np.triu(alike, 1) if alone else alike, cosines)

    return meetings.groupBy("cell", "i", "j").applyInArrow(run, ddl)


def _star(alike: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least reachable number of each row and column of a matrix of links, from their own numbers."""
    left, right = left.copy(), right.copy()
    rows, columns = np.nonzero(alike)
    while True:
        before = left.copy(), right.copy()
        np.minimum.at(right, columns, left[rows])
        np.minimum.at(left, rows, right[columns])
        if (left == before[0]).all() and (right == before[1]).all():
            return left, right


def neighbours(
    df: DataFrame,
    doc: str = "path",
    vector: str = "embedding",
    minimum: float = 0.9,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per row of `df`: doc, n_neighbours (other rows with a cosine of at least `minimum`) and cluster
    (the least document reached from it over such rows, itself included).

    Exact to some 1e-12 of the cosine. A vector that is null, empty or zero, or has a component that is null
    or not finite, has no neighbours; all others must be of one length, else the job fails. A row without
    a document id is nobody's neighbour and has no cluster. Only the two named columns are read.
    """
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be above 0 and at most 1")
    classes = cut(_classes(df, doc, vector))
    meetings = _meetings(classes, minimum, pivots, block_rows)
    kind = classes.schema["node"].dataType.simpleString()

    def found(left: pa.Table, right: pa.Table, alike: np.ndarray, _: np.ndarray) -> pa.Table:
        nodes = pa.concat_tables([left.select(["node"]), right.select(["node"])]).column("node").combine_chunks()
        a, b = left.column("n").to_numpy(), right.column("n").to_numpy()
        links = np.concatenate([alike @ b, alike.T @ a])
        places = np.arange(len(nodes))
        if left is right:  # a row and its column are one
            places = np.tile(np.arange(len(a)), 2)
            alike = alike | alike.T | np.eye(len(a), dtype=bool)
        roots = np.concatenate(_star(alike, places[: len(a)], places[len(a) :]))
        some = np.flatnonzero(links)
        return pa.table({"node": nodes.take(some), "links": pa.array(links[some]), "root": nodes.take(roots[some])})

    if meetings is None:
        counted = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("cluster"))
    else:
        met = cut(_compared(meetings, minimum, found, f"node {kind}, links long, root {kind}"))
        links = met.groupBy("node").agg(F.sum("links").alias("links"))
        edges = met.filter(F.col("node") != F.col("root")).select(F.col("node").alias("source"), F.col("root").alias("target"))
        counted = links.join(connected(edges).select("node", "cluster"), "node", "left")
    stats = classes.drop("vector").join(counted, "node", "left").select(
        *_KEYS,
        "n",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_neighbours"),
        F.coalesce("cluster", "node").alias("cluster"),
    )
    own = F.col(vector).cast("array<double>")
    can = _usable(vector) & F.col(doc).isNotNull()
    rows = df.select(
        F.col(doc).alias("_doc"),
        F.when(can, F.xxhash64(own)).alias("_a"),
        F.when(can, F.xxhash64(F.lit(1), own)).alias("_b"),
    )
    rest = rows.filter(F.col("_a").isNull()).select(
        F.col("_doc").alias(doc), F.lit(0).cast("long").alias("n_neighbours"), F.col("_doc").alias("cluster")
    )
    joined = join_groups(rows.filter(F.col("_a").isNotNull()), stats, _KEYS, F.col("_doc"), hot_rows=hot_rows)
    return joined.select(F.col("_doc").alias(doc), "n_neighbours", "cluster").unionByName(rest)


def neighbour_pairs(
    df: DataFrame,
    doc: str = "path",
    vector: str = "embedding",
    minimum: float = 0.9,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (source, target, similarity), source < target: every two different vectors with a cosine of at least
    `minimum`, each vector under the least document that has it. Their number is that of the links, which a crowd
    of vectors near each other makes quadratic; `neighbours` counts and joins them without listing any."""
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be above 0 and at most 1")
    classes = cut(_classes(df, doc, vector))
    meetings = _meetings(classes, minimum, pivots, block_rows)
    kind = classes.schema["node"].dataType.simpleString()

    def found(left: pa.Table, right: pa.Table, alike: np.ndarray, cosines: np.ndarray) -> pa.Table:
        a, b = np.nonzero(alike)
        ends = {"a": left.column("node").take(pa.array(a)), "b": right.column("node").take(pa.array(b))}
        return pa.table({**ends, "similarity": pa.array(cosines[a, b])})

    if meetings is None:  # no vector, hence no row
        none = F.col("node")
        return classes.select(none.alias("source"), none.alias("target"), F.lit(0.0).alias("similarity"))
    pairs = _compared(meetings, minimum, found, f"a {kind}, b {kind}, similarity double")
    return pairs.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "similarity")
