"""What the corpus operators share: checked broadcasts, drops of single rows, connected components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard
from ..session import materialised as written
from ..session import with_package as package_sent

__all__ = ["broadcast_if_short", "broadcast_if_small", "connected_components", "discard", "few", "slices", "text_mark", "with_package", "without_rows", "written"]

#: Bytes that a table with a broadcast hint may take in a hash relation.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row in a hash relation: its header and pointers, then each column.
ROW_BYTES, COLUMN_BYTES = 40, 8


def few(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table of longs is small enough for a broadcast, counted unless its rows are given."""
    n = df.count() if rows is None else rows
    return n * (ROW_BYTES + COLUMN_BYTES * len(df.columns)) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (of longs) with a broadcast hint if it takes at most BROADCAST_BYTES; otherwise df, for a shuffle join."""
    return F.broadcast(df) if few(df, rows) else df


def broadcast_if_short(df: DataFrame, text_col: str) -> DataFrame:
    """As broadcast_if_small, for a table of longs and one column of texts, whose longest counts for all."""
    n, longest = df.agg(F.count(F.lit(1)), F.max(F.octet_length(text_col))).first()
    return F.broadcast(df) if n * (ROW_BYTES + COLUMN_BYTES * len(df.columns) + (longest or 0)) <= BROADCAST_BYTES else df


#: Rows of an Arrow batch: whole texts make batches large, in the JVM and in the Python worker at once.
BATCH_ROWS = 2000


def with_package(spark: SparkSession) -> None:
    """Let Python workers import this package, and have texts sent to them in small batches unless the session asks for some size."""
    package_sent(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":  # Spark's default
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of few rows, so that a task turns only these into Python objects at a time.

    At the end of a task its memory goes back to the system, as the worker stays for tasks of later stages.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_mark(text: str | Column) -> Column:
    """A hash by which rows of one doc_id with different texts are told apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows named by gone (doc_id, mark, once), all columns as they are; a null doc_id is an id like any other.

    A row is named by its doc_id and text_mark(text), so other texts of the same doc_id stay. Where once is true, one row
    of those so named stays: which one of them is left open, as they differ in neither id nor text.
    """
    gone = written(gone, "gone")
    tag = uuid.uuid4().hex  # no column of docs has such a name
    mine, there, mark, once = (f"__{part}_{tag}" for part in ("mark", "id", "there", "once"))
    names = gone.select(F.col("doc_id").alias(there), F.col("mark").alias(mark), F.col("once").alias(once))
    marked = docs.withColumn(mine, text_mark(docs[text_col]))
    same = lambda right: marked[id_col].eqNullSafe(right[there]) & (marked[mine] == right[mark])
    every = broadcast_if_small(names)
    left = marked.join(every, same(every), "left_anti")
    repeated = names.where(F.col(once))
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        left = left.unionByName(marked.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, mine]))
    return left.drop(mine)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, component) of an undirected graph given as edges (a, b): component is the smallest vertex reachable.

    Every round each vertex hooks to its smallest neighbour, the hooks are shortened by one jump, and the edges are
    rewritten between the hooked-to vertices. A component's smallest vertex always survives, so it is the last root.
    Only vertices that have an edge are returned; self loops and repeated edges do no harm. Rounds are written tables,
    deleted when the next round has been written.
    """
    pairs = lambda e: (
        e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    live = written(pairs(edges), label)
    roots = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        hook = written(hook, label)
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = hook.join(up, "p").select("v", F.col("pp").alias("p"))
        for _ in range(2):  # two more jumps shorten long hooks at little cost
            up = jump.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jump = jump.join(up, "p").select("v", F.col("pp").alias("p"))
        jump = written(jump, label)
        if roots is None:
            newer = jump.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
        else:
            step = jump.select(F.col("v").alias("component"), "p")
            newer = roots.join(step, "component", "left").select("vertex", F.coalesce("p", "component").alias("component"))
        newer = written(newer, label)
        ja = jump.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        jb = jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = written(
            pairs(live.join(ja, "a").join(jb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), label
        )
        discard(hook, jump, live, roots)
        live, roots = rest, newer
    if roots is None:
        kind = live.schema["a"].dataType
        return live.select(F.col("a").cast(kind).alias("vertex"), F.col("b").cast(kind).alias("component"))
    discard(live)
    return roots
