"""Near-duplicate vectors of one label by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centre; their residuals are coded by one of
256 centres in each subspace. Vectors of each length have a quantiser of their own: a quarter of the square root of their
number as lists, ``LISTS`` at least and ``MOST_LISTS`` at most (finer lists are probed by more vectors), fitted on a sample of ``SAMPLE`` vectors a list. Two unit vectors with the cosine limit
lie within a radius r of each other, which makes the probes sufficient: a vector x probes each list c
whose border with its own list c0 is within r, (|x-c|^2 - |x-c0|^2) / (2 |c-c0|) <= r, so no partner
can lie in a list that is not probed. Asymmetric distances come from lookup tables of x against the
codes; a partner y with coding error e has a table distance of at most r + e, so what the tables drop
cannot be a partner either. The exact cosine in double precision decides.

Equal vectors of a label are one class with a count. Lists are compared block by block, at most about ``BLOCK``
members against ``SIDE`` probes in a task, and a task sends link counts and a spanning set of links, not
all pairs. Vectors that are null, zero, or hold null or non-finite
components, and vectors without label or id, link with nothing; vectors of different lengths never link. Repeated rows of an id count
as one vector; of an id with several, the least label and vector in their order count, for all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crowdread.llm.components import components
from crowdread.llm.staging import release, staged

SAMPLE = 128
LISTS, MOST_LISTS = 32, 1024
PARTS = 8
CODES = 256
BLOCK, SIDE = 1024, 4096
SLACK = 1e-6


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    best = d.argmin(1)
    return best, np.maximum(d[np.arange(len(x)), best], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample, from evenly spaced starts; fewer distinct vectors give fewer centres."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        owner, _ = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Quantiser:
    """Coarse centres and the centres of the residuals in each subspace."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS):
        self.coarse = k_means(sample, lists)
        owner, _ = nearest(sample, self.coarse)
        residuals = sample - self.coarse[owner]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(residuals[:, a:b], CODES) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        owner, _ = nearest(x, self.coarse)
        residuals = x - self.coarse[owner]
        codes, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for p, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            codes[:, p], part = nearest(residuals[:, a:b], book)
            error += part
        return owner, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, list) of all lists that can hold a vector within the radius."""
        c = self.coarse
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        own = d.argmin(1)
        between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-300))
        return np.nonzero((d - d[np.arange(len(x)), own][:, None]) / (2 * between[own]) <= radius + SLACK)

    def distances(self, x: np.ndarray, list_of: int, codes: np.ndarray) -> np.ndarray:
        """Distances of every x to every coded vector of one list, from lookup tables."""
        residuals = x - self.coarse[list_of]
        total = np.zeros((len(x), len(codes)))
        for p, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            part = residuals[:, a:b]
            lookup = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += lookup[:, codes[:, p]]
        return np.sqrt(np.maximum(total, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component, so that squares stay finite."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def span(rows: np.ndarray, columns: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of the links (rows[i], columns[i]) between the ids a and b."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a[rows].tolist(), b[columns].tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def links_of(classes: DataFrame, quantiser: Quantiser, limit: float) -> DataFrame:
    """Rows (a, n, b): n vectors of other classes are linked with class a, or b is linked with it."""
    shared = classes.sparkSession.sparkContext.broadcast(quantiser)
    radius = float(np.sqrt(max(0.0, 2 - 2 * limit)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(matrix(batch.column("vector")))
            owner, codes, error = shared.value.encode(x)
            who, probed = shared.value.probes(x, radius)
            n, m = len(x), len(who)
            rows = batch.select(["label", "id", "size", "vector"]).take(pa.array(np.concatenate([np.arange(n), who])))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array(np.concatenate([owner, probed]).astype(np.int32)),
                    pa.array([*(c.tobytes() for c in codes), *[None] * m], pa.binary()),
                    pa.array(np.concatenate([error, np.zeros(m)])),
                    pa.array(np.arange(n + m) < n),
                ],
                ["label", "id", "size", "vector", "list", "codes", "error", "member"],
            )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        member = group.column("member").to_numpy()
        left, right = group.filter(pa.array(~member)), group.filter(pa.array(member))
        out: list[tuple[int, int, int | None]] = []
        if left.num_rows and right.num_rows:
            x, y = (units(matrix(t.column("vector").combine_chunks())) for t in (left, right))
            a, b = (np.asarray(t.column("id")) for t in (left, right))
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
            near = shared.value.distances(x, group.column("list")[0].as_py(), codes)
            rows, columns = np.nonzero((near <= radius + SLACK + np.asarray(right.column("error"))) & (a[:, None] != b))
            good = np.concatenate(
                [(x[rows[s : s + 50_000]] * y[columns[s : s + 50_000]]).sum(1) >= limit for s in range(0, len(rows), 50_000)] or [np.zeros(0, bool)]
            )
            rows, columns = rows[good], columns[good]
            counts = np.bincount(rows, np.asarray(right.column("size"))[columns], len(a)).astype(np.int64)
            out += [(int(a[i]), int(counts[i]), None) for i in np.flatnonzero(counts)]
            out += [(i, 0, j) for i, j in span(rows, columns, a, b)]
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["a", "n", "b"])

    label = classes.schema["label"].dataType.simpleString()
    placed = staged(
        classes.mapInArrow(
            place, f"label {label}, id long, size long, vector array<double>, list int, codes binary, error double, member boolean"
        ),
        "placed",
    )
    keys = ["label", "list"]
    sizes = placed.groupBy(*keys).agg(
        F.ceil(F.count(F.when(F.col("member"), 1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(~F.col("member"), 1)) / SIDE).cast("int").alias("sides"),
    )
    rows = placed.join(sizes, keys)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    members = rows.filter("member").withColumn("block", mine(F.col("blocks"))).withColumn("side", F.explode(every(F.col("sides"))))
    probes = rows.filter("NOT member").withColumn("side", mine(F.col("sides"))).withColumn("block", F.explode(every(F.col("blocks"))))
    found = members.unionByName(probes).groupBy(*keys, "block", "side").applyInArrow(compare, "a long, n long, b long")
    out = staged(found, "found")
    release(placed)
    return out


def near_duplicates(vectors: DataFrame, limit: float = 0.98, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable, itself included) and kept.

    ``sample`` times the number of lists bounds the vectors that centres are fitted on; every vector is indexed and probed.
    ``lists`` sets their number instead of the number of vectors. Each length of vectors is a pass of its own.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
    usable = usable.filter(F.forall("vector", finite) & F.exists("vector", lambda v: v != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = staged(classes, "classes")
    lengths = classes.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for width, n in lengths:
        mine = classes.filter(F.size("vector") == width)
        count = lists or min(MOST_LISTS, max(LISTS, math.isqrt(n) // 4))
        picked = mine.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample * count).collect()
        links = links_of(mine, Quantiser(units(np.array([r.vector for r in picked])), count), limit)
        found = links if found is None else found.unionByName(links)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "component")
    of_class = classes.join(counts, "id", "left").join(roots, "id", "left")
    of_class = staged(
        of_class.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "id").alias("component")),
        "links",
    )
    each = usable.join(of_class, ["label", "vector"]).select("vec_id", "n", "component")
    all_rows = rows.select("vec_id").join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return all_rows.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
