"""Near-duplicate embeddings by product quantisation over coarse inverted lists.

Vectors of one label with equal components are collapsed first. Each distinct vector goes to the
inverted list of its nearest coarse centroid and keeps one byte for each subspace of its residual,
with the length of what the codes miss. As a query, a vector probes every list whose cell boundary
is near enough to it; there it compares itself by table lookup with the codes (the asymmetric
distance), and pairs that the distance plus the known coding error cannot rule out are compared
by exact cosine in double precision. Lists are dealt out as blocks of bounded size; their number
grows with the square root of the number of distinct vectors.

Only the codebooks are fitted on a sample (``train_rows`` vectors or ``PER_LIST`` for each list, about);
every row is indexed and every row is a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import connected_components, materialize, pick, unit_hash
from .hashing import mix

#: Rows of a block of an inverted list, and vectors to fit each list's centroid on.
BLOCK = 1024
PER_LIST = 16
#: Numbers in a table of distances at most.
CELLS = 4_000_000
SUBSPACES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of unit length; those that are zero or not finite become zero."""
    x = x.astype(np.float64)
    x[~np.isfinite(x).all(axis=1)] = 0
    scale = np.abs(x).max(axis=1, initial=0)
    ok = scale > 0
    x[ok] /= scale[ok, None]
    x[ok] /= np.sqrt(np.einsum("ij,ij->i", x[ok], x[ok]))[:, None]
    return x


def _rows(column, kind: str) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    step = max(1, CELLS // len(c))
    return np.concatenate([_nearest(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _closest(x, c)
        total, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and, for each subspace of the residuals, a codebook of up to 256 entries."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = SUBSPACES):
        self.coarse = kmeans(x, lists)
        residual = x - self.coarse[_closest(x, self.coarse)]
        self.cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], 256, 8, 1) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the coding error) of unit vectors."""
        at = _nearest(x, self.coarse).argmin(1)
        rest = x - self.coarse[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            codes[:, m] = _nearest(rest[:, a:b], book).argmin(1)
            rest[:, a:b] -= book[codes[:, m]]
        return at, codes, np.sqrt((rest * rest).sum(1))

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector probes: those whose boundary with its own list is within ``reach``."""
        return self.beyond(x, _nearest(x, self.coarse).argmin(1), np.arange(len(self.coarse))) <= reach

    def beyond(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """How far the boundaries of each vector's own list with ``lists`` are from it."""
        d, c = _nearest(x, self.coarse[lists]), self.coarse[own]
        gap = (d - ((x - c) ** 2).sum(1)[:, None]) / (2 * np.maximum(np.sqrt(_nearest(c, self.coarse[lists])), 1e-12))
        gap[own[:, None] == lists[None]] = 0
        return gap

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of list ``at``."""
        rest = (x - self.coarse[at]).astype(np.float32)
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            out += _nearest(rest[:, a:b], book.astype(np.float32))[:, codes[:, m]]
        return out


def _prepare(dim: int, kind: str):
    """(id, label, node, vector): node is a hash of label and unit components, null for unusable rows."""

    def run(batches):
        for batch in batches:
            rows, label = batch.column("vec").to_pylist(), batch.column("label").to_pylist()
            x = np.zeros((len(rows), dim), kind)
            for i, r in enumerate(rows):
                if r is not None and len(r) == dim and label[i] is not None and None not in r:
                    x[i] = r
            unit = _unit(x)
            ok = unit.any(axis=1)
            bits = unit.view(np.uint64) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mark = mix(np.array([v or 0 for v in label], np.int64).view(np.uint64) + np.uint64(1))
            node = mix(mix(bits) ^ mark[:, None]).sum(axis=1, dtype=np.uint64).view(np.int64)
            packed = [v.tobytes() if good else None for v, good in zip(x, ok)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(node, mask=~ok), pa.array(packed, pa.binary())], ["id", "label", "node", "vec"])

    return run


def _components_in_block(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row reachable from each of ``rows`` by the links a-b."""
    label = np.arange(rows)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _index(quantiser, reach: float, kind: str):
    """A row for each list that a vector probes, with its own list; the codes only where it is that."""

    def run(batches):
        q = quantiser.value
        step = max(1, CELLS // len(q.coarse))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                x = _unit(_rows(batch.column("vec"), kind))
                at, codes, miss = q.encode(x)
                take, probed = np.nonzero(q.probes(x, reach))
                own = at[take] == probed
                columns = [pa.array(probed, pa.int32()), pa.array(at[take], pa.int32()), pa.array(miss[take]), pa.array([codes[i].tobytes() if o else None for i, o in zip(take, own)], pa.binary())]
                kept = batch.select(["label", "node", "w", "vec"]).take(pa.array(take))
                yield pa.RecordBatch.from_arrays(columns + kept.columns, ["list", "home", "miss", "codes", "label", "node", "w", "vec"])

    return run


def _compare(quantiser, threshold: float, reach: float, kind: str):
    """One block of queries against one block of a list: links of each vector, and edges that join them."""
    radius = math.sqrt(2 - 2 * threshold)

    def run(key, table):
        q = quantiser.value
        query, data = table.filter(pc.equal(table["side"], 0)), table.filter(pc.equal(table["side"], 1))
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not query.num_rows or not data.num_rows:
            return none
        at = key[1].as_py()
        x, y, codes = _unit(_rows(query["vec"], kind)), _unit(_rows(data["vec"], kind)), _rows(data["codes"], "u1")
        near = np.sqrt(np.maximum(0, q.distances(x, at, codes))) <= radius + data["miss"].to_numpy()[None] + 1e-3
        a, b = np.nonzero(near)
        nx, ny = query["node"].to_numpy(), data["node"].to_numpy()
        keep = nx[a] != ny[b]
        a, b = a[keep], b[keep]
        cosine = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], y[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.empty(0)])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        if not len(a):
            return none
        wx, wy = query["w"].to_numpy(), data["w"].to_numpy()
        links = np.bincount(a, wy[b], len(nx)).astype(np.int64)
        # The other way round only where that vector does not probe the query's list itself.
        lists, which = np.unique(query["home"].to_numpy()[a], return_inverse=True)
        back = np.zeros(len(ny), np.int64)
        probed = (q.beyond(y, np.full(len(y), at), lists) <= reach)[b, which]
        np.add.at(back, b[~probed], wx[a[~probed]])
        where = {n: i for i, n in enumerate(dict.fromkeys([*nx[a].tolist(), *ny[b].tolist()]))}
        names = np.array(list(where), np.int64)
        root = _components_in_block(len(names), np.array([where[n] for n in nx[a].tolist()]), np.array([where[n] for n in ny[b].tolist()]))
        node = np.concatenate([nx, ny, names])
        count = np.concatenate([links, back, np.zeros(len(names), np.int64)])
        other = np.concatenate([nx, ny, names[root]])
        keep = (count > 0) | (node != other)
        return pa.table({"node": node[keep], "links": count[keep], "other": other[keep]})

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", train_rows: int = 20000, sigmas: float = 3.5) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null and their cosine in double precision is
    at least ``threshold``. Null vectors, zero vectors, vectors with null or non-finite components
    and those of another length than most link with nothing, as do rows with a null label. Labels of any type that
    casts to text are told apart by a 64-bit hash. Rows of one
    id belong to one component; rows with a null id link with nothing and have a null component and
    null ``kept``. Further columns are ignored; an empty table gives an empty result.

    ``sigmas`` sets how far beyond a cell's boundary is searched: a partner at the threshold
    lies in a random direction, so its offset along any boundary's normal is near normal with
    deviation radius / sqrt(dimension). Of two partners on either side of a boundary one is within half their
    offset of it, and a link is found if either probes the other's list, so vectors probe half as far.
    """
    given = pick(vectors, id_col, vec_col, label_col).toDF("id", "vec", "label")
    kind = "<f4" if isinstance(given.schema["vec"].dataType.elementType, FloatType) else "<f8"
    vec = F.col("vec") if kind == "<f4" else F.col("vec").cast("array<double>")
    given = given.select(F.col("id").cast("long"), vec.alias("vec"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label"))
    sizes = given.where("id is not null and vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes and sizes["d"] else 1
    usable = F.when((F.size("vec") == dim) & F.col("id").isNotNull(), F.col("vec"))
    rows = materialize(given.select("id", "label", usable.alias("vec")).mapInArrow(_prepare(dim, kind), "id long, label long, node long, vec binary"), "vectors")
    nodes = rows.where("node is not null").groupBy("label", "node").agg(F.count("*").alias("w"), F.min("id").alias("least"), F.first("vec").alias("vec"))
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    spark = rows.sparkSession
    if n:
        lists = max(1, math.isqrt(n))
        sample = nodes.where(unit_hash(F.col("node")) < F.lit(min(1.0, max(train_rows, PER_LIST * lists) / n))).select("node", "vec").collect()
        sample = sorted(sample, key=lambda r: r["node"]) or nodes.select("node", "vec").limit(1).collect()
        x = _unit(np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), kind).reshape(len(sample), -1))
        quantiser = spark.sparkContext.broadcast(Quantiser(x, lists))
        reach = sigmas / 2 * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
        index = nodes.select("label", "node", "w", "vec").mapInArrow(_index(quantiser, reach, kind), "list int, home int, miss double, codes binary, label long, node long, w long, vec binary")
        index = materialize(index, "index")
        # Blocks: as many of each side as a list's size asks for.
        count = index.groupBy("label", "list").agg(F.count_if(F.col("list") == F.col("home")).alias("data"), F.count("*").alias("queries"))
        parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
        count = materialize(count.select("label", "list", parts("data").alias("nd"), parts("queries").alias("nq")).where("nd > 0"), "count")
        placed = index.join(count, ["label", "list"])
        some = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
        cols = ["label", "list", "qb", "db", "side", "home", "node", "w", "miss", "codes", "vec"]
        query = placed.select("*", some("nq", 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), F.lit(0).alias("side")).select(cols)
        data = placed.where("list = home").select("*", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), some("nd", 2).alias("db"), F.lit(1).alias("side")).select(cols)
        # By all four, so that the blocks of a large list go to many tasks.
        met = query.unionByName(data).repartition("label", "list", "qb", "db").groupBy("label", "list", "qb", "db").applyInArrow(_compare(quantiser, threshold, reach, kind), "node long, links long, other long")
        met = materialize(met, "met")
        links = met.groupBy("node").agg(F.sum("links").alias("links"))
        parts_ = connected_components(met.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(_same_id(rows)))
    else:
        links = spark.createDataFrame([], "node long, links long")
        parts_ = spark.createDataFrame([], "id long, component long")
    parts_ = materialize(parts_, "parts")
    named = nodes.select("node", "w", "least").join(parts_.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left")
    named = materialize(named.select("node", "w", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    label = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "label")
    named = materialize(named.join(label, "component").select("node", (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id"), "named")
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _same_id(rows: DataFrame) -> DataFrame:
    """Edges between different vectors under one id."""
    named = rows.where("node is not null").select("id", "node")
    several = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    return named.join(several, "id").where("node <> a").select("a", F.col("node").alias("b"))
