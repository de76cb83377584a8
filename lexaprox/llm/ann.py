"""Approximate nearest neighbours by balanced posting lists.

Largest inner product is turned into smallest distance: a vector x is completed
by sqrt(M^2 - |x|^2), M being the largest norm, so all lie on one sphere, and a
query by 0, at length M. Centroids are the leaves of a tree of balanced 2-means
splits of a bounded sample (SAMPLE_BYTES of vectors, those with the smallest
hash of their id), moved REFINE times to the mean of what is nearest to them,
and drawn out to the sphere. They are held by a graph in memory: each is joined
to its nearest centroids and to some far ones, and a beam of the closest is
widened step by step.

Every vector goes to the list of its nearest centroid, and, near a boundary,
also to others whose distance is at most (1 + CLOSURE) times that, up to
REPLICAS lists. A query reads the lists whose distance is at most some ratio of
the mean of its NEAREST nearest ones (the single nearest is a chance reference:
by it the lists read for the same recall are nearly twice as many), and the next
ones until what they hold suffices. The ratio is fitted: CALIBRATION queries are
compared with the whole sample, and the ratio is the least by which a share of
AIM of their nearest in the sample would be read. In a larger table the nearest
are nearer, so it finds no less there. Lists have about LIST_SIZE vectors, as
long as there are no more than MAX_LISTS of them.

Neighbouring lists are packed. A vector, or a query, has one row for each pack
it is in; packs and their queries are dealt out in blocks of bounded size, so
one hot vector is no task of its own; and a block lets out one row for each
query, with its k best. Of equal vectors only the smallest ids can be among the
k nearest, so each distinct vector keeps k + 1 of its ids; that is lossless.
What is compared is exact: inner products in double precision on the original
vectors, summed in one fixed order.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those without the commonest number of
components; rows with a null id take no part; of rows with the same id the one
whose components are the smallest bytes counts; an empty table gives no rows;
with fewer candidates than k all that are found come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, release

SAMPLE_BYTES, MAX_LISTS, LIST_SIZE, REFINE = 1 << 25, 8192, 32, 2
CLOSURE, REPLICAS = 0.2, 4
NEAREST, CALIBRATION, AIM = 16, 256, 0.955
#: Packs of neighbouring lists, at least (while there are as many lists).
PACKS = 32
#: Rows of a pack, and queries, that meet in one call.
BLOCK, QUERY_BLOCK = 32_768, 4096


def balanced_leaves(x: np.ndarray, leaves: int, seed: int = 7) -> np.ndarray:
    """Centroids of so many equal parts, halving along a 2-means direction."""
    rng = np.random.default_rng(seed)
    parts, out = [(x, leaves)], []
    while parts:
        p, n = parts.pop()
        if n <= 1 or len(p) < 2:
            if len(p):
                out.append(p.mean(0))
            continue
        c = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(6):
            side = ((p - c[0]) ** 2).sum(1) - ((p - c[1]) ** 2).sum(1)
            near = side <= np.median(side)
            if near.all() or not near.any():
                break
            c = np.stack([p[near].mean(0), p[~near].mean(0)])
        order = np.argsort(((p - c[0]) ** 2).sum(1) - ((p - c[1]) ** 2).sum(1), kind="stable")
        cut = len(p) * (n // 2) // n
        parts += [(p[order[:cut]], n // 2), (p[order[cut:]], n - n // 2)]
    return np.array(out)


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids on the sphere of the completed vectors x, neighbours together."""
    radius = np.sqrt((x[:1].astype(np.float64) ** 2).sum())
    c = balanced_leaves(x, lists)
    for again in range(REFINE + 1):
        c = (c * (radius / np.maximum(np.sqrt((c**2).sum(1, keepdims=True)), 1e-300))).astype(np.float32)
        if again < REFINE:
            near = np.concatenate([(x[lo : lo + 2048] @ c.T).argmax(1) for lo in range(0, len(x), 2048)])
            n, total = np.bincount(near, minlength=len(c)), np.zeros(c.shape)
            np.add.at(total, near, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Graph:
    """Centroids with their nearest and some far ones, searched by a beam."""

    def __init__(self, points: np.ndarray, near: int = 20, far: int = 3, seed: int = 3):
        self.points, n = points.astype(np.float32), len(points)
        self.norms = (self.points**2).sum(1)
        rng, near = np.random.default_rng(seed), min(near, n - 1)
        links = np.empty((n, near), dtype=np.int32)
        for lo in range(0, n, 1024) if near else ():
            d = self.norms[None] - 2 * self.points[lo : lo + 1024] @ self.points.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 1024] = np.argpartition(d, near - 1, axis=1)[:, :near]
        self.links = np.concatenate([links, rng.integers(0, n, (n, far)).astype(np.int32)], 1) if n > 1 else np.zeros((n, 1), np.int32)
        self.entry = rng.choice(n, min(n, max(8, int(n**0.5))), replace=False)

    def reference(self, dist: np.ndarray) -> np.ndarray:
        """The mean distance of the nearest of points at these distances."""
        m = min(NEAREST, dist.shape[1], 1 + len(self.points) // 25)
        near = np.partition(dist, m - 1, axis=1)[:, :m]
        return np.where(np.isfinite(near), near, near.min(1, keepdims=True)).mean(1)

    def search(self, q: np.ndarray, beam: int, ratio: float | None = None, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the closest points found, closest first, and their
        distances (infinite where there are fewer): `beam` of them, and with a
        ratio at least all within that of the reference. The beam's points are
        widened, so many at once, until all of them are."""
        n, b = len(self.points), len(q)
        q, beam = q.astype(np.float32), min(n, beam)
        qq, rows = (q**2).sum(1, dtype=np.float32), np.arange(b)[:, None]
        far = lambda ids: np.sqrt(np.maximum(self.norms[ids] - 2 * np.einsum("bd,bnd->bn", q, self.points[ids]) + qq[:, None], 0))
        ids = np.broadcast_to(self.entry, (b, len(self.entry)))
        dist, seen, done = far(ids), np.zeros((b, n), bool), np.zeros(ids.shape, bool)
        seen[rows, ids] = True
        first = np.empty((b, n), np.int16)
        while True:
            m = min(beam, dist.shape[1]) - 1
            bound, width = np.partition(dist, m, axis=1)[:, m], beam
            if ratio is not None:
                bound = np.maximum(bound, ratio * self.reference(dist))
                width = max(beam, int((dist <= bound[:, None]).sum(1).max()))
            if dist.shape[1] > width:
                top = np.argpartition(dist, width - 1, axis=1)[:, :width]
                ids, dist, done = (np.take_along_axis(v, top, 1) for v in (ids, dist, done))
            open_d = np.where(done | ~(dist <= bound[:, None]), np.inf, dist)
            k = min(at_once, dist.shape[1])
            at = np.argpartition(open_d, k - 1, axis=1)[:, :k]
            live = np.isfinite(np.take_along_axis(open_d, at, 1))
            if not live.any():
                break
            done[rows, at] |= live
            new = self.links[ids[rows, at]].reshape(b, -1)
            skip = seen[rows, new] | ~np.repeat(live, self.links.shape[1], axis=1)
            # A point linked twice comes once: the place written last.
            place = np.arange(new.shape[1], dtype=np.int16)[None]
            first[rows, new] = place
            skip |= first[rows, new] != place
            seen[rows, new] |= ~skip
            d = np.where(skip, np.inf, far(new))
            ids, dist, done = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([done, skip], 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.float64).reshape(-1, dims)


def lists_of_vectors(graph: Graph, x: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a row of x is replicated to."""
    full = np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))[:, None]], 1)
    ids, d = graph.search(full, 24)
    ids, d = ids[:, :REPLICAS], d[:, :REPLICAS]
    keep = d <= (1 + CLOSURE) * d[:, :1]
    keep[:, 0] = True
    return np.nonzero(keep)[0], ids[keep]


def asking(q: np.ndarray, largest: float) -> np.ndarray:
    """Queries as points at the distance of the sphere."""
    return np.concatenate([q * (largest / np.sqrt((q**2).sum(1, keepdims=True))), np.zeros((len(q), 1))], 1).astype(np.float32)


def fitted_ratio(graph: Graph, q: np.ndarray, x: np.ndarray, largest: float, k: int) -> float:
    """The least ratio by which AIM of the k nearest of each of q among x, its own
    copy left out, stand in lists that the query would read."""
    # A float32 more or less decides nothing here.
    full, take = asking(q, largest), min(k, len(x))
    near, real = (np.empty((len(q), take), t) for t in (np.int64, bool))
    length = np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1)), 1e-300).astype(np.float32)
    for lo in range(0, len(q), 32):
        score = full[lo : lo + 32, :-1] @ x.T
        score[np.abs(score / (length * np.float32(largest)) - 1) < 1e-6] = -np.inf
        at = np.argpartition(-score, take - 1, axis=1)[:, :take]
        near[lo : lo + 32], real[lo : lo + 32] = at, np.isfinite(np.take_along_axis(score, at, 1))
    which, at = np.unique(near, return_inverse=True)
    row, lists = lists_of_vectors(graph, x[which].astype(np.float64), largest)
    d = np.sqrt(np.maximum(graph.norms[None] - 2 * full @ graph.points.T + (full**2).sum(1, keepdims=True), 0))
    d /= graph.reference(d)[:, None]
    own = np.full((len(which), REPLICAS), -1)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    own[row, nth] = lists
    own = own[at.reshape(near.shape)]
    needed = np.where(own >= 0, d[np.arange(len(q))[:, None, None], own], np.inf).min(2)
    needed = needed[real]
    return float(np.quantile(needed, AIM)) * (1 + 1e-6) if len(needed) else 1.0


def lists_of_queries(graph: Graph, q: np.ndarray, largest: float, ratio: float, sizes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a query reads; sizes: rows of each list, of
    which a query reads `need` at least, or all."""
    ids, d = graph.search(asking(q, largest), 2 * NEAREST, ratio, 16)
    found = np.isfinite(d)
    held = np.where(found, sizes[ids], 0)
    keep = found & ((d <= ratio * graph.reference(d)[:, None]) | (held.cumsum(1) - held < need))
    row, lists = np.nonzero(keep)[0], ids[keep]
    short = np.flatnonzero((held * keep).sum(1) < need)
    row, lists = row[~np.isin(row, short)], lists[~np.isin(row, short)]
    every = len(graph.points)
    return np.concatenate([row, np.repeat(short, every)]), np.concatenate([lists, np.tile(np.arange(every), len(short))])


def _by_pack(batches: Iterator[pa.RecordBatch], find, kind: str, dims: int, lists: int, packs: int) -> Iterator[pa.RecordBatch]:
    """A row for each pack that a vector or query has lists in, with these lists."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            row, own = find(_matrix(part.column("vec"), kind, dims))
            order = np.lexsort((own, row))
            row, own = row[order], own[order].astype(np.int32)
            pack = own.astype(np.int64) * packs // lists
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(pack, prepend=-1) != 0))
            ends = np.append(first[1:], len(own))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("vec").take(at), pa.array(pack[first].astype(np.int32)), pa.array([own[a:e].tobytes() for a, e in zip(first, ends)], pa.binary())], names=["id", "vec", "pack", "lists"])


def _best(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row r, each id once, best first."""
    order = np.lexsort((ids, -score, r))
    again = np.zeros(len(order), bool)
    again[1:] = (r[order][1:] == r[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[~again]
    rr = r[order]
    return order[np.arange(len(rr)) - np.searchsorted(rr, rr) < k]


def _pairs(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of a column of packed lists."""
    return np.repeat(np.arange(len(column)), [len(v) // 4 for v in column]), np.frombuffer(b"".join(column), dtype=np.int32)


FOUND = "query_id long, ids binary, scores binary"


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, kind: str, dims: int) -> pd.DataFrame:
    """A row for each of a block of queries: the k best of one block of a pack,
    among the rows of the lists that it reads."""
    out: list[tuple] = []
    if len(left) and len(right):
        x, asked = (np.frombuffer(b"".join(t["vec"]), dtype=kind).astype(np.float64).reshape(-1, dims) for t in (right, left))
        all_ids, asked_ids = right["id"].to_numpy(), left["id"].to_numpy()
        (row, own), (query, wanted) = _pairs(right["lists"]), _pairs(left["lists"])
        names = np.unique(np.concatenate([own, wanted]))
        own, wanted = np.searchsorted(names, own), np.searchsorted(names, wanted)
        # Queries that read alike stand together, so that each group skips what none of it reads.
        order = np.argsort(np.array([v for v in left["lists"]], dtype=object), kind="stable")
        for lo in range(0, len(order), 256):
            group = order[lo : lo + 256]
            seat = np.full(len(left), -1)
            seat[group] = np.arange(len(group))
            mine = seat[query] >= 0
            reads = np.zeros((len(group), len(names)), bool)
            reads[seat[query[mine]], wanted[mine]] = True
            some = reads.any(0)[own]
            rows, at = np.unique(row[some], return_inverse=True)
            if not len(rows):
                continue
            allowed = np.zeros((len(group), len(rows)), bool)
            # Each row's lists one by one: its first, its second, and so on.
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            for j in range(int(nth.max()) + 1):
                pick = nth == j
                allowed[:, at[pick]] |= reads[:, own[some][pick]]
            rough = np.where(allowed, asked[group] @ x[rows].T, -np.inf)
            take = min(k + 1, len(rows))
            floor = np.partition(rough, len(rows) - take, axis=1)[:, len(rows) - take]
            # The product's rounding depends on the place; what may tie is summed again in one order.
            r, c = np.nonzero(allowed & (rough >= np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)[:, None]))
            ids = all_ids[rows[c]]
            other = ids != asked_ids[group[r]]
            r, c, ids = r[other], c[other], ids[other]
            score = (asked[group[r]] * x[rows[c]]).sum(1)
            best = _best(r, ids, score, k)
            r = r[best]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            for a, e in zip(first, np.append(first[1:], len(r))):
                out.append((int(asked_ids[group[r[a]]]), ids[best[a:e]].astype(np.int64).tobytes(), score[best[a:e]].tobytes()))
    return pd.DataFrame(out, columns=["query_id", "ids", "scores"])


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query, from rows in the order of query_id."""
    held: list[tuple] = []

    def best(rows: list[tuple]) -> pa.RecordBatch:
        n = [len(v) // 8 for _, v, _ in rows]
        query = np.repeat(np.array([q for q, _, _ in rows], dtype=np.int64), n)
        ids, scores = (np.frombuffer(b"".join(v[c] for v in rows), dtype=t) for c, t in ((1, np.int64), (2, np.float64)))
        at = _best(query, ids, scores, k)
        q = query[at]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array((np.arange(len(q)) - np.searchsorted(q, q) + 1).astype(np.int32)), pa.array(ids[at]), pa.array(scores[at])], names=["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("query_id", "ids", "scores"))))
        held = [r for r in rows if r[0] == rows[-1][0]]
        if len(held) < len(rows):
            yield best(rows[: len(rows) - len(held)])
    if held:
        yield best(held)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dims, square): vectors that take part, as little-endian numbers
    of their own precision in a binary, with their squared length."""
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("v")).filter(
        "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, offsets = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.offsets) - v.offsets[0].as_py() if len(v) else [0]
            # 0.0 for -0.0, so that equal vectors are equal bytes.
            own = [flat[lo:hi] + flat.dtype.type(0) for lo, hi in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(np.diff(offsets).astype(np.int32)), pa.array([float((x.astype(np.float64) ** 2).sum()) for x in own], pa.float64())], names=["id", "vec", "dims", "square"])

    return ok.mapInArrow(packed, "id long, vec binary, dims int, square double")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each of `queries` the k vectors
    with the largest inner product that the index finds, ties to smaller ids."""
    spark = vectors.sparkSession
    once = lambda df: df.groupBy("id", "dims").agg(F.min(F.struct("vec", "square")).alias("v")).select("id", "v.vec", "dims", "v.square")
    every = materialize(once(usable(vectors, id_col, vec_col)), "vectors")
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    common = every.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, largest = common["dims"], float(common["square"]) ** 0.5 * (1 + 1e-9)
    asked = once(usable(queries, id_col, vec_col)).filter(F.col("dims") == dims)
    if kind == "<f4" and queries.schema[vec_col].dataType.elementType.typeName() != "float":
        raise TypeError("queries must have the vectors' precision")
    # Equal vectors: the k + 1 smallest ids, first within each of many parts of a hot one.
    by = Window.partitionBy("vec", "part").orderBy("id")
    some = every.filter(F.col("dims") == dims).select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k + 1)
    kept = materialize(some.withColumn("at", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("at") <= k + 1).select("id", "vec", "at"), "distinct-vectors")
    release(every)
    few = max(1024, SAMPLE_BYTES // (8 * dims))
    sample = [r[0] for r in kept.filter("at = 1").orderBy(F.xxhash64("id"), "id").limit(few).select("vec").collect()]
    x = np.frombuffer(b"".join(map(bytes, sample)), dtype=kind).astype(np.float64).reshape(-1, dims)
    x = np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))[:, None]], 1).astype(np.float32)
    lists = int(min(MAX_LISTS, max(1, kept.count() // LIST_SIZE), max(1, len(x) // 4)))
    graph = Graph(centroids(x, lists))
    lists = len(graph.points)
    packs = int(min(lists, max(PACKS, kept.count() * REPLICAS // BLOCK)))
    some = [r[0] for r in asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).select("vec").collect()]
    ratio = fitted_ratio(graph, np.frombuffer(b"".join(map(bytes, some)), dtype=kind).astype(np.float64).reshape(-1, dims), x[:, :-1], largest, k) if some else 1.0
    sent = spark.sparkContext.broadcast(graph)
    shape, dealt_as = "id long, vec binary, pack int, lists binary", (kind, dims, lists, packs)
    posted = materialize(kept.select("id", "vec").mapInArrow(lambda it: _by_pack(it, lambda m: lists_of_vectors(sent.value, m, largest), *dealt_as), shape), "postings")
    release(kept)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(lists, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.int32), minlength=lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["list", "n"])

    sizes = np.zeros(lists, np.int64)
    for r in posted.select("lists").mapInArrow(counted, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    need = 2 * REPLICAS * (k + 1)
    reading = materialize(asked.select("id", "vec").mapInArrow(lambda it: _by_pack(it, lambda m: lists_of_queries(sent.value, m, largest, ratio, sizes, need), *dealt_as), shape), "probes")
    blocks = lambda df, name, most: df.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # A row for each pack, MAX_LISTS at most.
    dealt = F.broadcast(blocks(posted, "parts", BLOCK).join(blocks(reading, "groups", QUERY_BLOCK), "pack"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = reading.join(dealt, "pack").select("id", "vec", "lists", "pack", own("groups").alias("group"), each("parts").alias("part"))
    right = posted.join(dealt, "pack").select("id", "vec", "lists", "pack", own("parts").alias("part"), each("groups").alias("group"))
    key = ["pack", "part", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _nearest(a, b, k, kind, dims), FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _ranked(it, k), "query_id long, rank int, vec_id long, score double")
