"""Embedding near-duplicates: a subspace pigeonhole join.

Two unit vectors with cosine >= t are within squared distance 2 - 2t. After one random rotation
the coordinates fall into blocks; if the blocks' squared distances sum to at most that budget, at
least one block is within its proportional share. So each block is range-joined on its own, in two steps:

1. Of each vector only the block's coordinates travel, a byte each. A grid on the first of them has cells as
   wide as the block's radius; a vector stands in its cell and asks those of the later neighbours that its ball
   reaches. In a cell, strips of the next two coordinates say which vectors are compared at all; what comes out
   is each vector that has another within the radius and the bytes' rounding error, not the pairs.
2. Whole vectors are fetched for those alone, and meet in the same cells. A pair within the block's share, in
   double precision, is verified exactly on the whole vectors; it counts in the first block that finds it.

Equal vectors of a label are one class. Tasks never emit pairs: they emit each class's number of
links and a spanning forest of the links they found, so a dense cell costs its square in arithmetic
but a line of rows. A cell with more than CELL_ROWS classes is split into sub-blocks that meet
pairwise in tasks of their own.

In 64 random dimensions a ball reaches far: two blocks and a grid of two copy a vector about nine times, and 1.09
times all pairs share a cell; the strips leave 0.87 times all pairs to be compared with 3,000 vectors a label, 0.72
with 20,000. More coordinates or blocks share fewer cells but copy more (three coordinates: 0.75 at 22 copies).

Nulls: a null label, null vector, null or non-finite component or zero vector links with nothing
and is its own component. Rows that repeat a vec_id count as vectors of their own. Vectors of
different lengths never link. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Stage
from lattica.llm.components import connected_components

BLOCKS = 2
GRID = 2
CELL_ROWS = 2000
#: Rows of a strip of the next two coordinates.
STRIP_ROWS = 64
#: Steps of a byte's coordinate.
SCALE = 127
SEED = 20_240_229


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(blobs, kind: str) -> np.ndarray:
    """Rows of float64 from a binary column whose values have one length."""
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def _units(vecs: np.ndarray) -> np.ndarray:
    vecs = vecs / np.abs(vecs).max(1, keepdims=True)  # so that no square overflows
    return vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True))


def _cuts(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


def _steps(grid: int) -> list[tuple[int, ...]]:
    """A cell itself, then its neighbours that come later in lexicographic order."""
    every = np.stack(np.meshgrid(*[[-1, 0, 1]] * grid, indexing="ij"), -1).reshape(-1, grid)
    return [(0,) * grid, *(tuple(x) for x in every.tolist() if tuple(x) > (0,) * grid)]


PLACE = "label string, dim int, cell binary, own boolean, class long"


def _spread(threshold: float, blocks: int, grid: int, kind: str):
    """PLACE and coords: a class in its own cell of each block, and as a guest in the later cells that its ball reaches."""
    budget = 2 - 2 * threshold
    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            blobs = [np.asarray(x.values, kind).tobytes() for x in batch.column(2)]
            for k, x in enumerate(blobs):
                by_dim.setdefault(len(x) // width, []).append(k)
            packed = pa.array(blobs, pa.binary())
            for dim, rows in by_dim.items():
                for part in np.array_split(np.array(rows), -(-len(rows) // 1000)):
                    take = pa.array(part)
                    vec, cls, label = packed.take(take), batch.column(0).take(take), batch.column(1).take(take)
                    turned = _units(_matrix(vec, kind)) @ _rotation(dim)
                    for j, (a, b) in enumerate(_cuts(dim, blocks)):
                        radius = np.sqrt(budget * (b - a) / dim) + 1e-9
                        first = turned[:, a : min(a + grid, b)]
                        cells = np.floor(first / radius).astype(np.int32)
                        inside = first - cells * radius
                        coords = pa.array([x.tobytes() for x in np.rint(turned[:, a:b] * SCALE).astype(np.int8)], pa.binary())
                        for k, step in enumerate(_steps(cells.shape[1])):
                            s = np.array(step, np.int32)
                            gap = np.where(s > 0, radius - inside, np.where(s < 0, inside, 0.0))
                            reached = np.flatnonzero((gap * gap).sum(1) <= radius * radius * (1 + 1e-9))
                            if not len(reached):
                                continue
                            names = np.column_stack([np.full(len(reached), j, np.int32), cells[reached] + s])
                            bins = pa.array([x.tobytes() for x in names], pa.binary())
                            some = pa.array(reached)
                            fixed = pa.array(np.full(len(reached), dim, np.int32)), pa.array(np.full(len(reached), k == 0))
                            yield pa.RecordBatch.from_arrays([label.take(some), fixed[0], bins, fixed[1], cls.take(some), coords.take(some)], names=["label", "dim", "cell", "own", "class", "coords"])

    return run


def _meeting(spread: DataFrame, label: str, cols: list[str]):
    """The groups of a cell: own rows of part p with those of part q >= p, and with the guests of part q - parts."""
    cell = ["label", "dim", "cell"]
    hot = spread.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    hot = Stage(hot.select(*cell, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")), label)
    met = spread.join(hot.df, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    last = F.when(F.col("parts") == 1, 0).otherwise(2 * F.col("parts") - 1)
    mine = met.where("own").withColumn("q", F.explode(F.sequence("part", last))).withColumn("p", F.col("part")).withColumn("side", F.lit(0))
    theirs = met.where("own and part > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).withColumn("q", F.col("part")).withColumn("side", F.lit(2))
    guests = met.where("not own").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("q", F.when(F.col("parts") == 1, 0).otherwise(F.col("parts") + F.col("part"))).withColumn("side", F.lit(1))
    cols = [*cell, "p", "q", "side", *cols]
    return mine.select(cols).union(theirs.select(cols)).union(guests.select(cols)).groupBy(*cell, "p", "q")


def _strips(x: np.ndarray, y: np.ndarray, rows: np.ndarray, radius: float):
    """Runs of at most STRIP_ROWS of rows that lie near each other in x, and then in y."""
    strip = np.floor(x[rows] / radius)
    order = rows[np.lexsort((y[rows], strip))]
    edges = np.flatnonzero(np.diff(np.sort(strip))) + 1
    for run in np.split(order, edges):
        for lo in range(0, len(run), STRIP_ROWS):
            yield run[lo : lo + STRIP_ROWS]


def _beside(x: np.ndarray, y: np.ndarray, left: np.ndarray, wide: np.ndarray, radius: float):
    """(rows of left, rows of wide that are within the radius of them in x and y) for each strip of left."""
    wide = wide[np.argsort(x[wide], kind="stable")]
    for run in _strips(x, y, left, radius):
        lo, hi = np.searchsorted(x[wide], x[run].min() - radius, "left"), np.searchsorted(x[wide], x[run].max() + radius, "right")
        some = wide[lo:hi]
        yield run, some[(y[some] >= y[run].min() - radius) & (y[some] <= y[run].max() + radius)]


def _sides(key, table):
    side = np.asarray(table["side"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    whole = key[3].as_py() == key[4].as_py()
    return side, left, np.concatenate([left, right]) if whole else right, whole


def _next_two(coords: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates behind the grid's, or the last ones of a short block."""
    last = coords.shape[1] - 1
    return coords[:, min(grid, last)], coords[:, min(grid + 1, last)]


def _near(threshold: float, blocks: int, grid: int):
    """(PLACE) of the classes of a group that have another within the block's radius, by the bytes."""
    budget = 2 - 2 * threshold

    def run(key, table):
        side, left, wide, whole = _sides(key, table)
        coords = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table["coords"]), np.int8).reshape(table.num_rows, -1).astype(np.float32) / SCALE
        found = np.zeros(table.num_rows, bool)
        if len(left) and len(wide) > whole:
            dim, size = key[1].as_py(), coords.shape[1]
            radius = np.sqrt(budget * size / dim) + np.sqrt(size) / SCALE + 1e-5  # a coordinate is off by half a step at most
            square = (coords**2).sum(1)
            for run_, some in _beside(*_next_two(coords, grid), left, wide, radius):
                for at in range(0, len(some), 4096):
                    other = some[at : at + 4096]
                    near = square[run_][:, None] + square[other][None] - 2 * coords[run_] @ coords[other].T <= radius * radius + 1e-5
                    if whole:
                        near &= run_[:, None] != other[None]
                    found[run_[near.any(1)]] = True
                    found[other[near.any(0)]] = True
        return table.select(["label", "dim", "cell", "own", "class"]).filter(pa.array(found))

    return run


def _packed(kind: str):
    """The last column, an array of numbers, as bytes."""

    def run(batches):
        for batch in batches:
            blobs = pa.array([np.asarray(x.values, kind).tobytes() for x in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], blobs], names=batch.schema.names)

    return run


#: side: 0 rows of sub-block p of a cell, 1 its guests, 2 rows of a later sub-block q.
FOUND = "a long, b long, n long"


def _links(threshold: float, blocks: int, grid: int, kind: str):
    """Links in a cell, as (class, null, n): n links of a class, and (class, class, null): an edge of their forest."""
    budget = 2 - 2 * threshold

    def run(key, table):
        side, left, wide, whole = _sides(key, table)
        ids, sizes = (np.asarray(table[c]) for c in ("class", "size"))
        links, parent, edges = np.zeros(len(ids), np.int64), list(range(len(ids))), []

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        if len(left) and len(wide) > whole:
            units = _units(_matrix(table["vec"], kind))
            turned = units @ _rotation(units.shape[1])
            block = int(np.frombuffer(key[2].as_py(), np.int32)[0])
            spans = _cuts(units.shape[1], blocks)[: block + 1]
            shares = [budget * (b - a) / units.shape[1] + 1e-9 for a, b in spans]
            (a, b), most = spans[-1], shares[-1]
            square = (turned[:, a:b] ** 2).sum(1)
            for mine, some in _beside(*_next_two(turned[:, a:b], grid), left, wide, np.sqrt(most) + 1e-9):
                for at in range(0, len(some), 4096):
                    other = some[at : at + 4096]
                    near = square[mine][:, None] + square[other][None] - 2 * turned[mine, a:b] @ turned[other, a:b].T <= most
                    if whole:
                        near &= (side[other] != 0)[None] | (mine[:, None] < other[None])
                    i, j = np.nonzero(near)
                    for cut in range(0, len(i), 1 << 16):
                        p, q = mine[i[cut : cut + (1 << 16)]], other[j[cut : cut + (1 << 16)]]
                        keep = np.einsum("ij,ij->i", units[p], units[q]) >= threshold
                        p, q = p[keep], q[keep]
                        for (c, d), share in zip(spans[:-1], shares, strict=False):  # found by an earlier block: counted there
                            fresh = (turned[p, c:d] ** 2).sum(1) + (turned[q, c:d] ** 2).sum(1) - 2 * (turned[p, c:d] * turned[q, c:d]).sum(1) > share
                            p, q = p[fresh], q[fresh]
                        np.add.at(links, p, sizes[q])
                        np.add.at(links, q, sizes[p])
                        for s, t in zip(p.tolist(), q.tolist(), strict=True):
                            s, t = root(s), root(t)
                            if s != t:
                                parent[max(s, t)] = min(s, t)
                                edges.append((ids[s], ids[t]))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*ids[some], *(x for x, _ in edges)], pa.int64()), "b": pa.array([None] * len(some) + [y for _, y in edges], pa.int64()), "n": pa.array([*links[some], *[None] * len(edges)], pa.int64())})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id: str = "vec_id", vec: str = "embedding", label: str = "label", blocks: int = BLOCKS, grid: int = GRID) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; links join equal labels with cosine >= threshold."""
    element = vectors.schema[vec].dataType.elementType
    kind, sql = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vec).cast(f"array<{sql}>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(sound, F.lit(False)), F.transform("vec", lambda x: x + F.lit(0.0).cast(sql))))
    rows = Stage(rows, "vectors")
    usable = rows.df.where("vec is not null").withColumn("class", F.xxhash64("label", "vec"))
    classes = Stage(usable.groupBy("class", F.col("label").cast("string").alias("label"), "vec").agg(F.count("*").alias("size"), F.min("id").alias("least")), "classes")

    spread = classes.df.select("class", "label", "vec").mapInArrow(_spread(threshold, blocks, grid, kind), f"{PLACE}, coords binary")
    near = _meeting(spread, "hot-cells", ["own", "class", "coords"]).applyInArrow(_near(threshold, blocks, grid), PLACE)
    near = Stage(near.distinct(), "near")
    fetched = near.df.join(classes.df.select("class", "size", "vec").hint("merge"), "class").select("label", "dim", "cell", "own", "class", "size", "vec")
    fetched = fetched.mapInArrow(_packed(kind), "label string, dim int, cell binary, own boolean, class long, size long, vec binary")
    found = _meeting(fetched, "hot-cells", ["class", "size", "vec"])
    found = Stage(found.applyInArrow(_links(threshold, blocks, grid, kind), FOUND), "links")

    links = found.df.where("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    roots = connected_components(found.df.where("b is not null")).withColumnRenamed("node", "class")
    sums = Stage(classes.df.select("class", "size", "least").join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "sums")
    least = sums.df.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = sums.df.join(least, "root").select("class", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = usable.join(per_class, "class").select("id", "n_links", "component_id")
    alone = rows.df.where("vec is null").select("id", F.lit(0).cast("long"), "id")
    return linked.union(alone).select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
