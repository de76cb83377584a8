"""What several operators of this subpackage share: shared-folder tables, word
splitting, hashing and tables of hot keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte tables: ASCII letters to lower case, everything else as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Where that is unset, a local session (a test) gets a temporary one;
    a cluster's executors would not see it, so there it is an error."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lexaprox-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and return its reader.

    This cuts the lineage, gives stable values to anything that depends on the
    partitioning, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexaprox_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lexaprox_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class Temporary:
    """Tables of one computation, deleted together when nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        self.tables.append(out)
        return out

    def clear(self) -> None:
        release(*self.tables)
        self.tables.clear()


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of an input never get further."""
    return df.select(*names)


def chunks(ids: list, texts: list, limit: int = 1 << 19):
    """Deal rows into lists of about limit characters; a longer text comes alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield ids[start:], texts[start:]


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt: str, ways: int = 16) -> DataFrame:
    """Inner join in which each key of `big` is dealt over `ways` tasks by a hash
    of its column `salt`; `small` (one row a key) is repeated that many times.
    A key with a third of all rows so becomes `ways` keys."""
    left = big.withColumn("_way", F.pmod(F.xxhash64(salt), F.lit(ways)).cast("int"))
    right = small.withColumn("_way", F.explode(F.array(*[F.lit(i) for i in range(ways)])))
    # A table that is small as Parquet can be large in memory: no broadcast.
    return left.join(right.hint("merge"), [*on, "_way"]).drop("_way")


def spread_join(big: DataFrame, small: DataFrame, key: str, size: str, salt: str, share: int = 128, ways: int = 16) -> DataFrame:
    """Inner join of big with small, a written table of one row a key that says as
    `size` how many rows of big it has. Keys with more than one in `share` of these
    rows, of which there are fewer than `share`, are dealt over `ways` tasks by a
    hash of big's column `salt`; the others are not repeated."""
    total = small.agg(F.sum(size)).first()[0] or 0
    large = [r[0] for r in small.filter((F.col(size) * share > total) & (F.col(size) > 100)).select(key).collect()]
    if not large:
        return big.join(small.hint("merge"), key)
    hot = F.col(key).isin(large)
    left = big.withColumn("_way", F.when(hot, F.pmod(F.xxhash64(salt), F.lit(ways)).cast("int")).otherwise(0))
    right = small.withColumn("_way", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "_way"]).drop("_way")


LOCAL_EDGES = 200_000


def _forest(batches):
    """(node, root) of the edges of one task by union-find."""
    import pyarrow as pa

    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if schema is not None:
        found = [(x, top(x)) for x in up]
        found = [r for r in found if r[0] != r[1]]
        kind = schema.field(0).type
        for lo in range(0, len(found), 10_000):
            node, root = zip(*found[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(root, kind)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table by alternating large-star and
    small-star steps: rows (node, root), root being the smallest node reached.
    Each step is a shuffle of the edges; nothing is collected. Nodes without an
    edge are not returned. Up to LOCAL_EDGES edges, which is checked, are joined
    in one task, which gives the same rows."""
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    if cur.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        kind = cur.schema["u"].dataType.simpleString()
        return materialize(cur.coalesce(1).mapInArrow(_forest, f"node {kind}, root {kind}"), "forest")
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = materialize(small, "small-star")
        # Finished when every node points at one root and no root points further.
        again = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() or small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        release(cur, large)
        cur = small
        if not again:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
