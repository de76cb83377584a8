"""Near-duplicate documents by a Chosen-Path set similarity join.

Each text becomes a set of hashed shingles, each set a vector of minwise values.
A tree starts with all documents in its root and branches: every node chooses
one or more minwise positions, by a hash of the node, and documents with the same
value there meet in a child. Nodes of at most NODE_LIMIT documents are compared
exhaustively. How many positions a node chooses on average is worked out from the
threshold and the number of trees (see branching), so that a pair at the
threshold is parted in all trees less than once in ten thousand at the deepest
level too. Where that would take more than MOST positions, nothing branches
beyond the first level.

What counts is the component, so a node whose documents are in one component by
the links found so far is finished. First every document is compared with the
smallest of its node, which joins groups of near copies at once. Large nodes that
are still open branch on, LEVELS at a time. Those that stay large are mostly families
of texts below the threshold, which branching does not part; they are compared
exhaustively too, by pairs of blocks, each block a task's: documents outside the
main component with all. Of a node's links only those come out that join
components. So no bucket is capped, no group is expanded into all its pairs, and
nothing that a chosen path has brought together is left out.

Defined results: null, empty and blank texts have no shingles and no links;
fewer words than the shingle length make one shingle; repeated rows and exact
copies are one class, compared once; rows with a null doc_id keep a null
component unless they are linked with others; columns other than the two named
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Temporary, chunks, components, lower_words, materialize, mix64, release, spread_join, text_batches

#: Minwise values of a document.
POSITIONS = 64
#: Nodes of up to so many documents are compared exhaustively.
NODE_LIMIT = 2048
TREES = 10
#: Open nodes that are larger branch so often, some levels at a time.
BRANCHINGS, LEVELS = 2, 3
#: How often a pair at the threshold may be parted in all trees; half of what is
#: promised, as a node can choose one position twice, which is not reckoned with.
MISSED = 5e-5
#: The least and most positions a node chooses, in hundredths.
LEAST, MOST = 118, 400
#: Partners of one document that are compared in one task.
BLOCK = 256
_MUL = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_A = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_B = mix64(np.arange(1001, POSITIONS + 1001, dtype=np.uint64))


def parted(percent: int, trees: int, root: int, deep: int, depth: int) -> float:
    """The probability that a pair at the threshold meets in no node `depth` levels
    down of any tree, if nodes choose root / 100 positions in the first level and
    deep / 100 in those below. All trees share the pair's agreeing positions."""
    p, out = percent / 100, 0.0
    for agreeing in range(POSITIONS + 1):
        a, x = agreeing / POSITIONS, 0.0
        for d in range(depth):
            whole, rest = divmod(root if d == depth - 1 else deep, 100)
            one = 1 - a + a * x
            x = one**whole * (1 - rest / 100 + rest / 100 * one)
        out += comb(POSITIONS, agreeing) * p**agreeing * (1 - p) ** (POSITIONS - agreeing) * x**trees
    return out


@lru_cache
def branching(percent: int, trees: int) -> tuple[int, int]:
    """(root, deep): the positions a node chooses on average, in hundredths, in the
    first level and in those below; deep is 0 where nothing is to branch there.
    root leaves most of MISSED to the levels below. At thresholds so low that not
    even all positions meet it (below about 15 %), root is all of them."""

    def smallest(most: int, ok) -> int:
        lo, hi = LEAST, most
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        return lo

    root = smallest(100 * POSITIONS, lambda b: parted(percent, trees, b, b, 1) <= MISSED / 10)
    deep = smallest(MOST + 1, lambda b: parted(percent, trees, root, b, 1 + BRANCHINGS * LEVELS) <= MISSED)
    return root, deep if deep <= MOST else 0


def shingle_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Sorted distinct hashed shingles of all texts, end to end; the end of each
    text's; and each text's words, joined (None without words)."""
    hashes, bounds, joined = [], [0], []
    for t in texts:
        w = lower_words(t)
        hashes.extend(map(xxhash.xxh3_64_intdigest, w))
        bounds.append(len(hashes))
        joined.append(b" ".join(w) if w else None)
    h = np.array(hashes, dtype=np.uint64)
    n = len(h)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j in range(width if len(rolled) else 0):
        rolled += mix64(h[j : j + len(rolled)] + _MUL[j]) * _MUL[j]
    rolled = mix64(rolled)
    parts, ends, at = [], [], 0
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo >= width:
            s = np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            own = np.uint64(hi - lo)
            for j, x in enumerate(h[lo:hi]):
                own = own + mix64(np.array([x + _MUL[j]], dtype=np.uint64))[0] * _MUL[j]
            s = mix64(np.array([own], dtype=np.uint64))
        else:
            s = np.empty(0, dtype=np.uint64)
        parts.append(s)
        at += len(s)
        ends.append(at)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(ends, dtype=np.int64), joined


def minwise(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of POSITIONS minwise values (as int32) for each non-empty set."""
    starts = np.concatenate([[0], ends[:-1]])
    starts = starts[starts < ends]
    out = np.empty((len(starts), POSITIONS), dtype=np.int32)
    for j in range(POSITIONS if len(starts) else 0):
        v = ((flat * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(v, starts).view(np.int32)
    return out


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()))
            for own, texts in chunks(rows, batch.column("text").to_pylist()):
                flat, ends, joined = shingle_sets(texts, width)
                sizes = np.diff(ends, prepend=0)
                values = minwise(flat, ends)
                full, short = iter(values), iter(values.astype(np.uint8))
                ids, hashes = zip(*own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([None if w is None else xxhash.xxh3_128_digest(w) for w in joined], pa.binary()), pa.array(sizes, pa.int64()), pa.array([next(full).tobytes() if n else None for n in sizes], pa.binary()), pa.array([next(short).tobytes() if n else None for n in sizes], pa.binary())],
                    names=["doc_id", "h", "cid", "n_shingles", "sig", "brief"],
                )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Whole shingle sets in place of the column text, the last one."""
    with np.errstate(over="ignore"):
        for batch in batches:
            rest = batch.schema.names[:-1]
            for rows, texts in chunks(list(range(batch.num_rows)), batch.column("text").to_pylist()):
                flat, ends, _ = shingle_sets(texts, width)
                items = [flat[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1]], ends)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), pa.array(items, pa.binary())], names=[*rest, "items"])


def _by_node(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[int, list, list, list]]:
    """Of rows in the order of node: the node, its documents, components and payloads."""
    node, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("node", "k", "comp", payload))):
            if row[0] != node:
                if len(rows) > 1:
                    yield node, *map(list, list(zip(*rows))[1:])
                node, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield node, *map(list, list(zip(*rows))[1:])


def _promising(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Documents of a node with a partner in another component of which at least
    so many minwise values agree in their last byte."""
    for node, k, comp, brief in _by_node(batches, "brief"):
        x, c = np.frombuffer(b"".join(brief), dtype=np.uint8).reshape(-1, POSITIONS), np.array(comp)
        agree = np.zeros((len(k), len(k)), np.uint8)
        for j in range(POSITIONS):
            agree += x[:, j, None] == x[None, :, j]
        keep = np.flatnonzero(((agree >= least) & (c[:, None] != c[None])).any(1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), node)), pa.array(np.array(k)[keep]), pa.array(c[keep])], names=["node", "k", "comp"])


def common(sets: list[np.ndarray], at_once: int = 1 << 23) -> np.ndarray:
    """The sizes of the intersections of different sets, a few items at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    items, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(place) > 1
    owner, place = owner[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    step = max(1, at_once // n)
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, [lo, lo + step])
        has = np.zeros((n, min(step, int(shared.sum()) - lo)), np.float32)
        has[owner[a:b], place[a:b] - lo] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def _joining(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each node, links between its components, one for each two that they join."""
    for _, k, comp, items in _by_node(batches, "items"):
        # Equal rows of the documents come twice.
        pick = list({x: i for i, x in enumerate(k)}.values())
        sets = [np.frombuffer(items[i], np.uint64) for i in pick]
        n, both = np.array([len(x) for x in sets]), common(sets)
        # A row of the matrix at a time: at most NODE_LIMIT numbers.
        found = [np.flatnonzero(100 * both[x, x + 1 :].astype(np.int64) >= percent * (n[x] + n[x + 1 :] - both[x, x + 1 :])) + x + 1 for x in range(len(n))]
        i, j = np.repeat(np.arange(len(n)), [len(x) for x in found]), np.concatenate(found)
        up = {comp[p]: comp[p] for p in pick}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(comp[pick[a]]), top(comp[pick[b]])
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append(sorted((k[pick[a]], k[pick[b]])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of which at least so many minwise values agree in their last byte."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS) for c in ("brief_a", "brief_b"))
        agree = (x == y).sum(1).astype(np.int32)
        at = pa.array(np.flatnonzero(agree >= least))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(agree).take(at)], names=["a", "b", "agree"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of hub and way, the hub's own first: links, by the
    exact intersection of full sets."""
    hub, own = None, np.empty(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for k, h, role, items in zip(*(batch.column(c).to_pylist() for c in ("k", "hub", "role", "items"))):
            x = np.frombuffer(items, np.uint64)
            if role == 0:
                hub, own = h, x
            elif h == hub:
                both = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(x) - both):
                    a.append(min(h, k))
                    b.append(max(h, k))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _children(node: str, depth: int, chosen: int, levels: int = 1) -> F.Column:
    """The nodes so many levels below a row's node that its document falls into;
    each chooses chosen / 100 positions on average."""
    nodes = f"array({node})"
    for d in range(depth, depth + levels):
        picks = f"sequence(1, IF(pmod(xxhash64(x, {d}), 100) < {chosen % 100}, {chosen // 100 + 1}, {chosen // 100}))"
        at = f"CAST(pmod(xxhash64(x, {d}, i), {POSITIONS}) AS INT)"
        # The value at a position: four bytes of the binary signature.
        nodes = f"flatten(transform({nodes}, x -> array_distinct(transform({picks}, i -> xxhash64(x, {d}, {at}, substring(sig, 4 * {at} + 1, 4))))))"
    return F.explode(F.expr(nodes))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, text_hash, first), one for each row of docs.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over
    their whole shingle sets; component_id is the smallest doc_id reachable over
    links and kept tells whether it is the document's own. first marks one document
    of each component, the one with the smallest (doc_id, text_hash), null ids last,
    and its repeated rows; (doc_id, text_hash) names a row among those with one
    doc_id. See the module's text for nulls, empty texts and repeated rows."""
    if not 1 <= width <= len(_MUL):
        raise ValueError(f"width must be 1 to {len(_MUL)}")
    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = materialize(base.mapInArrow(lambda it: _signed(it, width), "doc_id long, h long, cid binary, n_shingles long, sig binary, brief binary"), "signed")
    # Exact copies (the same words) are one class; a partial aggregate sees to groups of copies.
    # Every copy has the same signature, so the class takes that of any; (doc_id, h) names one copy.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "n_shingles", "sig", "brief")).alias("one")
    classes = signed.filter("cid IS NOT NULL").groupBy("cid").agg(one).select("cid", "one.doc_id", "one.h", F.col("one.n_shingles").alias("n"), "one.sig", "one.brief")
    # Written, so the numbers stay.
    classes = materialize(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    tmp = Temporary()
    links = _links(base, classes, width, percent, trees)
    part = _parts(links, tmp)
    # A component's name is the smallest doc_id of all its classes.
    own = classes.select("k", "cid", "doc_id", "h").join(part.withColumnRenamed("node", "k").hint("merge"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    own = tmp(own, "roots")
    # Its first row: the smallest (doc_id, text hash), null ids last.
    name = own.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("first"))
    label = own.join(name.hint("merge"), "root").select("cid", "component_id", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    copies = materialize(signed.filter("cid IS NOT NULL").groupBy("cid").agg(F.count(F.lit(1)).alias("copies")).join(label.hint("merge"), "cid"), "labels")
    tmp.clear()
    release(classes)
    words = spread_join(signed.filter("cid IS NOT NULL").select("doc_id", "h", "cid", "n_shingles"), copies, "cid", "copies", "doc_id")
    own_row = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    out = words.select("doc_id", "n_shingles", "component_id", F.col("h").alias("text_hash"), own_row.alias("first"))
    out = out.union(signed.filter("cid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("h").alias("text_hash"), F.lit(True).alias("first")))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "first")


def _links(base: DataFrame, classes: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """Links (a, b) between classes: enough of them to connect each component."""
    p, tmp = percent / 100, Temporary()
    # A pair at the threshold agrees in percent of the positions; five deviations below, it is out.
    least = max(0, int(POSITIONS * p - 5 * (POSITIONS * p * (1 - p)) ** 0.5))
    root, deep = branching(percent, trees)
    roots = F.expr(f"explode(transform(sequence(1, {trees}), t -> xxhash64('tree', t)))")
    nodes = tmp(classes.select("k", "sig", roots.alias("root")).select("k", _children("root", 0, root).alias("node")), "nodes")
    sizes = tmp(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("first")).filter("size > 1"), "sizes")
    rows = tmp(spread_join(nodes, sizes, "node", "size", "k"), "grown")
    # The same documents have the same first one in every tree, so there are few pairs. One for each document:
    near = _near(rows.filter("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct(), classes, percent, least, tmp)
    best = near.groupBy("b").agg(F.max("agree").alias("agree")).join(near.hint("merge"), ["b", "agree"]).groupBy("b").agg(F.min("a").alias("a"))
    links = _confirmed(best.select("a", "b"), base, classes, width, percent, tmp)
    rows = _with_components(rows.select("node", "k"), _parts(links, tmp))
    more = _compared(_descended(rows, classes, deep, tmp), base, classes, width, percent, least, tmp)
    tmp.clear()
    return links.union(more)


def _with_components(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows with the component of each one's k by the links so far as comp."""
    return rows.join(part.select(F.col("node").alias("k"), "root").hint("merge"), "k", "left").select(*rows.columns, F.coalesce("root", "k").alias("comp"))


def _open(rows: DataFrame) -> DataFrame:
    """(node, size) of nodes with more than one component."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("node", "size")


def _mains(rows: DataFrame) -> DataFrame:
    """(node, all, main, n): each node's documents, its largest component and that one's documents."""
    most = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"))
    return most.select("node", "all", F.col("m.comp").alias("main"), F.col("m.n").alias("n"))


def _compared(small: DataFrame, base: DataFrame, classes: DataFrame, width: int, percent: int, least: int, tmp: Temporary) -> DataFrame:
    """Links between components of the nodes (node, k, comp), each compared exhaustively."""
    briefs = small.join(classes.select("k", "brief").hint("merge"), "k").select("node", "k", "comp", "brief").repartition("node").sortWithinPartitions("node")
    kept = tmp(briefs.mapInArrow(lambda it: _promising(it, least), "node long, k long, comp long"), "promising")
    sets = _with_sets(kept, base, classes, width).repartition("node").sortWithinPartitions("node")
    return materialize(sets.mapInArrow(lambda it: _joining(it, percent), "a long, b long"), "more-links")


def _descended(rows: DataFrame, classes: DataFrame, deep: int, tmp: Temporary) -> DataFrame:
    """From rows (node, k, comp) those of nodes with more than one component, large
    ones branched (unless deep is 0), and at last dealt into pairs of blocks."""
    small, depth = None, 1
    branchings = BRANCHINGS if deep else 0
    join = lambda a, b: b if a is None else a.union(b)
    for k in range(branchings + 1):
        sizes = tmp(_open(rows), "sizes")
        rows = tmp(spread_join(rows, sizes, "node", "size", "k"), "open")
        small = join(small, rows.filter(f"size <= {NODE_LIMIT}").select("node", "k", "comp"))
        many = rows.filter(f"size > {NODE_LIMIT}").select("node", "k", "comp")
        if not many.limit(1).count():
            return small
        if k < branchings:
            rows, depth = tmp(_branched(many, classes, depth, deep), "nodes"), depth + LEVELS
    return small.union(_blocks(many, tmp(_mains(many), "mains"), tmp))


def _blocks(many: DataFrame, mains: DataFrame, tmp: Temporary) -> DataFrame:
    """Pairs of blocks, as nodes, of the documents of those nodes that mains has:
    those outside a node's main component meet all."""
    half = NODE_LIMIT // 2
    number = lambda n: F.ceil(n / half).cast("int")
    mains = tmp(mains.select("node", "all", "main", number(F.col("all") - F.col("n")).alias("others"), number(F.col("all")).alias("blocks")), "block-numbers")
    dealt = spread_join(many, mains, "node", "all", "k")
    own = lambda c, salt: F.pmod(F.xxhash64("k", F.lit(salt)), F.col(c)).cast("int")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A pair of blocks is named by both; documents outside the main component are in some of either kind.
    first = dealt.filter("comp <> main").withColumn("i", own("others", 1)).withColumn("j", F.explode(each("blocks")))
    second = dealt.withColumn("j", own("blocks", 2)).withColumn("i", F.explode(each("others")))
    pairs = first.select("node", "k", "comp", "i", "j").union(second.select("node", "k", "comp", "i", "j")).distinct()
    return pairs.select(F.xxhash64("node", "i", "j").alias("node"), "k", "comp")


def _with_sets(rows: DataFrame, base: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """rows, of which one column is k, with the whole shingle sets of their
    documents as items. Sets are made anew from the texts, which costs less than
    keeping those of all documents."""
    at = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at")
    rest = [c for c in rows.columns if c != "k"]
    # A document's sets are made once for all its rows.
    own = rows.groupBy("k").agg(F.collect_list(F.struct(*rest)).alias("own"))
    named = classes.select("k", at, "h").join(own.hint("merge"), "k")
    # (at, h) names a row of the documents, or equal rows.
    texts = base.select(at, "h", "text").join(named.hint("merge"), ["at", "h"]).select("k", "own", "text")
    sets = texts.mapInArrow(lambda it: _sets(it, width), f"k long, own {named.schema['own'].dataType.simpleString()}, items binary")
    return sets.select("k", F.explode("own").alias("own"), "items").select(*[f"own.{c}" if c != "k" else c for c in rows.columns], "items")


def _branched(rows: DataFrame, classes: DataFrame, depth: int, deep: int) -> DataFrame:
    """(k, comp, node): the nodes LEVELS further that rows (node, k, comp) fall into."""
    return rows.join(classes.select("k", "sig").hint("merge"), "k").select("k", "comp", _children("node", depth, deep, LEVELS).alias("node"))


def _parts(links: DataFrame, tmp: Temporary) -> DataFrame:
    """(node, root) of all classes with a link, roots included."""
    part = components(links)
    tmp.tables.append(part)
    return tmp(part.union(part.select(F.col("root").alias("node"), "root").distinct()), "parts")


def _near(pairs: DataFrame, classes: DataFrame, percent: int, least: int, tmp: Temporary) -> DataFrame:
    """(a, b, agree): pairs that neither their sizes nor their minwise values keep apart."""
    side = lambda c: classes.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("brief").alias(f"brief_{c}")).hint("merge")
    pairs = tmp(pairs, "first-pairs")
    # The first one of a large group of near copies is in a pair with each.
    firsts = tmp(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("all")).join(side("a"), "a"), "firsts")
    pairs = spread_join(pairs, firsts, "a", "all", "b").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return tmp(pairs.mapInArrow(lambda it: _agree(it, least), "a long, b long, agree int"), "near")


def _confirmed(pairs: DataFrame, base: DataFrame, classes: DataFrame, width: int, percent: int, tmp: Temporary) -> DataFrame:
    """Those pairs that are links. A pair's second set goes to the first one's
    task, BLOCK to each, with a copy of the first."""
    pairs = tmp(pairs, "pairs")
    hubs = tmp(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("all"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ways")), "hubs")
    member = spread_join(pairs, hubs, "a", "all", "b").select(F.col("b").alias("k"), F.col("a").alias("hub"), F.lit(1).alias("role"), F.lit(1).alias("ways"), F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way"))
    hub = hubs.select(F.col("a").alias("k"), F.col("a").alias("hub"), F.lit(0).alias("role"), "ways", F.lit(0).alias("way"))
    sets = _with_sets(member.union(hub), base, classes, width)
    every = F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("ways") - 1)).otherwise(F.array("way")))
    dealt = sets.select("k", "hub", "role", every.alias("way"), "items").repartition("hub", "way").sortWithinPartitions("hub", "way", "role")
    return materialize(dealt.mapInArrow(lambda it: _linked(it, percent), "a long, b long"), "links")


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], chr(10)) AS s FROM places
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), links AS (
  SELECT a.r AS a, b.r AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (s) WHERE a.r <> b.r GROUP BY ALL
), edges AS (
  SELECT a, b FROM links JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reached AS (
  SELECT DISTINCT a, b FROM edges UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a
), least AS (
  SELECT a AS r, min(doc_id) AS doc_id FROM reached JOIN d ON d.r = b GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, least.doc_id) AS component_id, coalesce(d.doc_id <= least(d.doc_id, least.doc_id), true) AS kept
FROM d LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""
