"""Near-duplicate vectors by spherical k-means cells and blocked cosines.

Vectors of one label are compared. Unit vectors are assigned to the cell of
their nearest centroid; a vector visits another cell only if its angle to that
centroid is within the cell's radius plus the angle of the threshold, since by
the triangle inequality no link can lie elsewhere. So no pair is missed,
whatever the centroids. A cell's vectors are dealt to blocks of bounded size and
visitors to slices; each block is one matrix product per batch, which gives
counts of links and one link per vector to its part, never a list of pairs.

Equal vectors are compared once. Where a label's vectors lie in no clusters,
hardly any cell can be ruled out and the products grow with the square of that
label's distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

#: Vectors the centroids are fitted on, at most; distinct ones by least hash.
FIT_ROWS = 16384
#: Distinct vectors of one label in a cell that are aimed at; centroids at most.
CELL, MOST_CELLS = 512, 1024
#: Members of a cell in one block, and visitors in one slice, on average.
BLOCK, SLICE = 1024, 8192
#: Room for rounding in comparisons of angles.
SLACK = 1e-6


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors ``x``; an empty cell takes the vector
    that its centroid fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sims = x @ c.T
        own, best = sims.argmax(1), sims.max(1)
        worst = iter(np.argsort(best))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        for j in np.flatnonzero(np.bincount(own, minlength=len(c)) == 0):
            sums[j] = x[next(worst)]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1, 1))


def _units(column: pa.Array) -> list[bytes]:
    out = []
    for v in column.to_pylist():
        x = np.array(v, dtype=np.float64)
        scaled = x / np.abs(x).max()  # squares of very large or small components stay finite
        out.append((scaled / np.linalg.norm(scaled)).tobytes())
    return out


def _to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), b.column("weight"), pa.array(_units(b.column("vector")), pa.binary())], ["node", "space", "weight", "unit"])


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1)


def _placed(centroids: np.ndarray):
    """Nearest cell of each vector of the centroids' length and the angle to
    it; vectors of another length are in cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1] * 8
        for b in batches:
            units = b.column("unit").to_pylist()
            cell, angle = np.full(len(units), -1, dtype=np.int32), np.zeros(len(units))
            mine = [i for i, u in enumerate(units) if len(u) == width]
            if mine:
                a = _angles(np.frombuffer(b"".join(units[i] for i in mine)).reshape(len(mine), -1), centroids)
                cell[mine], angle[mine] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), b.column("weight"), b.column("unit"), pa.array(cell), pa.array(angle)], ["node", "space", "weight", "unit", "cell", "angle"])

    return run


def _visits(centroids: np.ndarray, radius: np.ndarray, reach: float):
    """The later cells each vector has to visit, as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            out: list[list[int]] = [[] for _ in cell]
            mine = np.flatnonzero(cell >= 0)
            if len(mine):
                near = _angles(_matrix(b.column("unit").take(pa.array(mine))), centroids) <= radius[None, :] + reach
                near &= np.arange(len(centroids))[None, :] > cell[mine][:, None]
                for i, row in zip(mine, near, strict=True):
                    out[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), b.column("weight"), b.column("unit"), b.column("cell"), pa.array(out, pa.list_(pa.int32()))], ["node", "space", "weight", "unit", "cell", "visits"])

    return run


def _parts(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least column number reachable from each row and column of a bipartite
    hit matrix; rows without hits get the number of columns."""
    n = hit.shape[1]
    cols = np.arange(n)
    while True:
        rows = np.where(hit, cols[None, :], n).min(1)
        new = np.minimum(cols, np.where(hit, rows[:, None], n).min(0)) if len(hit) else cols
        if (new == cols).all():
            return rows, cols
        cols = new


def _compared(least: float):
    """Rows sorted by block, homes before visitors: links counted by weight and
    one (node, other) a node. Only a block's homes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, home, nodes, weights = None, None, None, None

        def found(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["node", "other", "links"])

        for b in batches:
            key, role = b.column("block").to_numpy(), b.column("role").to_numpy()
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])))
            for at, to in zip(cut, np.append(cut[1:], len(key)), strict=True):
                part = b.slice(at, to - at)
                x, ids, w = _matrix(part.column("unit")), part.column("node").to_numpy(), part.column("weight").to_numpy()
                if role[at] < 2:  # homes; role 0 is compared within the block too
                    fresh = key[at] != block or home is None
                    if fresh:
                        block, home, nodes, weights = key[at], x, ids, w
                    if role[at] == 0:
                        hit = x @ home.T >= least if fresh else x @ np.concatenate([home, x]).T >= least
                        if not fresh:
                            home, nodes, weights = np.concatenate([home, x]), np.concatenate([nodes, ids]), np.concatenate([weights, w])
                        off = len(home) - len(x)
                        hit[np.arange(len(x)), off + np.arange(len(x))] = False
                        counts = hit @ weights
                        rows, _ = _parts(hit)
                        yes = counts > 0
                        if yes.any():
                            yield found(ids[yes], nodes[rows[yes]], counts[yes])
                        if off:  # earlier homes of the block gain the new ones
                            back = w @ hit[:, :off]
                            _, cols = _parts(hit)
                            if (back > 0).any():
                                yield found(nodes[:off][back > 0], nodes[cols[:off][back > 0]], back[back > 0])
                    elif not fresh:
                        home, nodes, weights = np.concatenate([home, x]), np.concatenate([nodes, ids]), np.concatenate([weights, w])
                elif key[at] == block:
                    hit = x @ home.T >= least
                    if hit.any():
                        rows, cols = _parts(hit)
                        yes = rows < len(home)
                        yield found(ids[yes], nodes[rows[yes]], (hit @ weights)[yes])
                        back = w @ hit
                        yield found(nodes[back > 0], nodes[cols[back > 0]], back[back > 0])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Two vectors link if their labels are equal and not null, their lengths are
    equal and their cosine in double precision is at least ``least``. A vector
    that is null, empty, zero, or holds a null or a non-finite component links
    with nothing, nor does one with a null label. ``n_links`` counts the other
    rows linked directly, repeated rows included. ``component_id`` is the least
    id reachable; a null id never is one unless it is alone. ``kept`` is true
    where it is the row's own id. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0.0), F.lit(False))
    space = F.when(sound, F.xxhash64("label", F.size("vector")))
    # Equal vectors of a label are one class, told by 128 bits; the classes are then numbered.
    same = F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64(F.lit(1), "label", "vector").alias("b"))
    rows = rows.withColumn("space", space).withColumn("same", F.when(sound, same))
    classes = rows.where("same is not null").groupBy("same").agg(F.first("space").alias("space"), F.count("*").alias("weight"), F.min("id").alias("least_id"), F.first("vector").alias("vector"))
    kept_classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    units = written(kept_classes.select("node", "space", "weight", "vector").mapInArrow(_to_units, "node bigint, space bigint, weight bigint, unit binary"))

    # Centroids from a bounded sample; exactness doesn't hang on them.
    largest = units.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    sample = units.orderBy(F.xxhash64("node", F.lit(3))).limit(FIT_ROWS).select("unit").collect()
    lengths: dict[int, list[bytes]] = {}
    for r in sample:
        lengths.setdefault(len(r["unit"]), []).append(bytes(r["unit"]))
    common = max(lengths.values(), key=len, default=[np.ones(1).tobytes()])
    x = np.frombuffer(b"".join(common)).reshape(len(common), -1)
    centroids = fit_centroids(x, min(MOST_CELLS, max(1, -(-largest // CELL))))

    placed = written(units.mapInArrow(_placed(centroids), "node bigint, space bigint, weight bigint, unit binary, cell int, angle double"))
    radius = np.full(len(centroids), -np.inf)
    for r in placed.where("cell >= 0").groupBy("cell").agg(F.max("angle").alias("r")).collect():  # one row a cell
        radius[r["cell"]] = r["r"]
    reach = float(np.arccos(least)) + SLACK
    visiting = placed.mapInArrow(_visits(centroids, radius, reach), "node bigint, space bigint, weight bigint, unit binary, cell int, visits array<int>")
    visiting = written(visiting)

    # How many blocks and slices each cell of a label needs.
    homes = visiting.groupBy("space", "cell").agg(F.count("*").alias("homes"))
    guests = visiting.select("space", F.explode("visits").alias("cell")).groupBy("space", "cell").agg(F.count("*").alias("guests"))
    plan = homes.join(guests, ["space", "cell"], "left").select(
        "space", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("homes") + F.coalesce("guests", F.lit(0))) / SLICE).cast("int").alias("slices"),
    )
    plan = written(plan)
    key = lambda sub, slice_: F.xxhash64("space", "cell", sub, slice_).alias("block")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    slice_ = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")
    at_home = visiting.drop("visits").join(plan, ["space", "cell"])
    as_home = at_home.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        key(own, F.col("s")), F.when(F.col("s") == 0, 0).otherwise(1).alias("role"), "node", "weight", "unit"
    )
    to_later = at_home.where("blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("b") > own)
    to_later = to_later.select(key(F.col("b"), slice_), F.lit(2).alias("role"), "node", "weight", "unit")
    away = visiting.select("space", "node", "weight", "unit", F.explode("visits").alias("cell")).join(plan, ["space", "cell"])
    away = away.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key(F.col("b"), slice_), F.lit(2).alias("role"), "node", "weight", "unit")
    dealt = as_home.unionByName(to_later).unionByName(away).repartition("block").sortWithinPartitions("block", "role")
    found = written(dealt.mapInArrow(_compared(least), "node bigint, other bigint, links bigint"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found, F.col("node"), F.col("other"))
    told = kept_classes.select("same", "node", "weight", "least_id").join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = told.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = told.join(least_ids, "component").select("same", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "same").join(told, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
