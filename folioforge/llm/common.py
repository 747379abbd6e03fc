"""Shared pieces: durable scratch space, byte-level tokens, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and Spark runs on one machine (tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """``df``; its session from now on sends Arrow batches bounded by bytes to Python, whatever the texts' lengths."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


_STATE: dict[str, object] = {}


def worker_state(name: str, make):
    """``make()``, kept for the later tasks of this Python process."""
    got = _STATE.get(name)
    if got is None:
        got = _STATE[name] = make()
    return got


def one_operator(name: str) -> None:
    """Called as a task starts: Python workers serve many stages, and what other operators left in this one goes."""
    if _STATE.get("operator") != name:
        _STATE.clear()
        _STATE["operator"] = name


def give_back() -> None:
    """Return memory that Arrow tables of a fit have taken and nothing uses any more."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(named(column), F.lit("")).cast("binary")


def scored_texts(docs: DataFrame, keep: list[str], text: str, name: str, scorer) -> DataFrame:
    """The ``keep`` columns of every row and the double column ``name``; no shuffle.

    ``scorer()`` is called once per task and gives a function from an array of
    texts (bytes) to scores.  A text column among ``keep`` travels once.
    """
    at = keep.index(text) if text in keep else len(keep)
    plain = [f"c{i}" for i in range(len(keep))]  # mapInArrow takes no names with dots
    rows = bounded_batches(docs).select(*(named(c).alias(p) for c, p in zip(keep, plain)), *([] if text in keep else [text_bytes(text).alias("text")]))
    schema = StructType([*(StructField(p, docs.schema[c].dataType) for c, p in zip(keep, plain)), StructField("score", DoubleType())])

    def run(batches):
        score = scorer()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], pa.array(score(texts), pa.float64())], [*plain, "score"])

    return rows.mapInArrow(run, schema).select(*(F.col(p).alias(c) for c, p in zip(keep, plain)), F.col("score").alias(name))


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, raw): of each key's texts the one whose hash is least; combined on the map side, so a hot key is no hot task."""
    least = F.min(F.struct(F.xxhash64("raw").alias("h"), F.col("raw")))
    return rows.groupBy(*keys).agg(least.alias("least")).select(*keys, F.col("least.raw").alias("raw"))


def split_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(named(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with only A-Z lower-cased (bytes methods are ASCII-only)."""
    return raw.lower().split()


#: A key with more than 1/HOT of all rows is hot; so there are fewer than HOT of them, a table that can always be broadcast.
HOT = 1000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """``rows`` left join ``facts`` (unique ``key``, and ``uses``: its rows) on ``key``, whatever the share of a key.

    Rows of hot keys and of null keys don't move: the hot facts, fewer than HOT
    rows, are broadcast.  In the shuffle join of the others no key has more than
    1/HOT of the rows.
    """
    hot = facts.where(F.col(uses) * HOT > F.lit(total)).drop(uses)
    rest = facts.where(F.col(uses) * HOT <= F.lit(total)).drop(uses)
    found = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    others = [c for c in hot.columns if c != key]
    still = found.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *others)
    return found.where(F.col("_hot").isNotNull() | F.col(key).isNull()).drop("_hot").unionByName(still.join(rest, key, "left"))


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def rows_marked(docs: DataFrame, keys: DataFrame, doc_id: str, mark: Column, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ``keys(doc_id, mark)``, whatever the columns of ``docs`` are called."""
    free = "_" * (1 + max(map(len, docs.columns)))
    named_apart = keys.select(F.col("doc_id").alias(free + "id"), F.col("mark").alias(free + "mark"))
    return docs.join(named_apart, named(doc_id).eqNullSafe(F.col(free + "id")) & (mark == F.col(free + "mark")), how)


def once_each(docs: DataFrame, several: DataFrame, doc_id: str, mark: Column) -> DataFrame:
    """``docs`` with one row instead of many where id and ``mark`` (a hash of the text) are among ``several(doc_id, mark)``.

    The row whose hash over all columns is least stays; combined on the map side.
    """
    if several.isEmpty():
        return docs
    keys = several.select("doc_id", "mark").distinct()
    some = rows_marked(docs, keys, doc_id, mark, "left_semi").groupBy(named(doc_id), mark)
    least = some.agg(F.min_by(F.struct(*map(named, docs.columns)), F.xxhash64(*map(named, docs.columns))).alias("r")).select("r.*")
    return rows_marked(docs, keys, doc_id, mark, "left_anti").union(least)


#: Edges that one task holds while it joins them to stars.
EDGES_A_TASK = 100_000


def _stars(batches):
    """(node, component) of the edges of a task, EDGES_A_TASK at a time: every node with the smallest one that those edges connect it with."""

    def told():
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in at.reshape(-1, 2).tolist():
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], ["node", "component"])

    held, n = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, EDGES_A_TASK):
            held.append(np.stack([batch.column(i).slice(k, EDGES_A_TASK).to_numpy() for i in (0, 1)], axis=1).ravel())
            n += len(held[-1]) // 2
            if n >= EDGES_A_TASK:
                yield told()
                held, n = [], 0
    if held:
        yield told()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component = smallest reachable node.

    Tasks first make stars of EDGES_A_TASK edges each, which is all where there are
    no more of them.  Then hash-to-min over label tables with pointer jumping: every
    round is two map-side combined aggregations; the joins on a hub rely on AQE to
    split its rows; rounds grow with the logarithm of the longest chain.  Round
    tables are written to the shared folder.
    """
    spark = edges.sparkSession
    links = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), f"{name}-links")
    tasks = max(1, -(-links.count() // EDGES_A_TASK))
    stars = materialize(links.coalesce(tasks).mapInArrow(_stars, "node long, component long"), f"{name}-stars")
    discard(spark, links)
    if tasks == 1:
        return stars
    edges = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-edges"
    )
    discard(spark, stars)
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        # the best label seen by any neighbour, hooked both on the node and on its present root
        seen = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("best"))
        )
        hooked = labels.join(seen, "node").select("node", "component", F.least("component", "best").alias("best"))
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("best").alias("up"))
        lifted = hooked.join(roots, hooked.component == roots.root, "left").select(
            "node", F.col("component").alias("old"), F.least("best", F.coalesce("up", "best")).alias("mid")
        )
        lifted = materialize(lifted, f"{name}-mid{step}")
        jump = lifted.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        new = materialize(
            lifted.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component")),
            f"{name}-{step}",
        )
        changed = not new.where("old <> component").isEmpty()
        discard(spark, labels)
        discard(spark, lifted)
        labels = new.select("node", "component")
        if not changed:
            discard(spark, both)
            return labels
