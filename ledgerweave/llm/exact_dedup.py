"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, text_mark, without_rows, written

#: Characters of the normalised text that the second key covers.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digests: bool) -> tuple[DataFrame, DataFrame]:
    """(all rows if digests are asked for, else the survivors; the survivors), each with doc_id, mark and sha.

    Survivors share length and prefix hash with another row. No text is shuffled: where the surviving prefixes are too
    many to broadcast, rows are hashed before the join that picks the survivors.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"), text_mark(F.col(text_col)).alias("mark"))
    sized = rows.select("doc_id", "mark", "body", F.length("body").cast("long").alias("len"))
    lengths = written(sized.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len"), "lengths")
    heads = sized
    if few(lengths):  # beyond it the next key does the whole work
        heads = sized.join(F.broadcast(lengths), "len", "left_semi")
    head = F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head")
    keys = heads.select("len", head).groupBy("len", "head").agg(F.count(F.lit(1)).alias("n"))
    keys = written(keys.where("n > 1").select("len", "head"), "prefixes")
    small = few(keys)
    sha = F.sha2(F.encode("body", "UTF-8"), 256).alias("sha")
    if digests:  # every row's digest is part of the answer
        full = written(sized.select("doc_id", "mark", "len", head, sha), "digests")
        return full, full.join(F.broadcast(keys) if small else keys, ["len", "head"], "left_semi")
    if small:  # only the survivors' whole texts are hashed
        live = sized.select("doc_id", "mark", "body", "len", head).join(F.broadcast(keys), ["len", "head"], "left_semi").select("doc_id", "mark", sha)
    else:
        live = sized.select("doc_id", "mark", "len", head, sha).join(keys, ["len", "head"], "left_semi").select("doc_id", "mark", "sha")
    live = written(live, "digests")
    return live, live


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digests: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; only rows of groups unless digests are asked for.

    Rows are first grouped by normalised length, then those of a shared length by a hash of their first characters, and
    only rows that still share a group need a hash of the whole text. Hot groups collapse in the partial aggregation.

    Defined cases: a null text is the empty text; equal texts with the same doc_id are rows of one document, so all of
    them carry the same keep_id and kept; a null doc_id never wins over another id, and a group of null ids alone keeps
    them; an empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    full, live = refined(docs, id_col, text_col, prefix_chars, digests)
    groups = live.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join below has an exchange of its own on either side and a hot hash can be split
    groups = written(groups.where("group_size > 1"), "groups")
    answer = full.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return answer if digests else answer.where("group_size > 1")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with one row of each group of equal normalised texts: that of the smallest doc_id; all columns stay as they are.

    Defined cases: rows are dropped one by one, so a doc_id's other texts stay; of rows that share both doc_id and text
    one stays, and of a doc_id's texts that differ in white space alone the one of the smallest hash; a null doc_id loses
    to any other and is dropped like any other; a null text is the empty text; column names don't matter.
    """
    _, live = refined(docs, id_col, text_col, prefix_chars, False)
    texts = live.groupBy("sha", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    texts = written(texts, "texts")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    groups = texts.groupBy("sha").agg(F.min(rank).alias("best"), F.sum("n").alias("size")).where("size > 1").select("sha", "best")
    found = texts.join(written(groups, "groups"), "sha")
    best = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    gone = found.where(~best | (F.col("n") > 1)).select("doc_id", "mark", best.alias("once"))
    return without_rows(docs, gone, id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


ORACLE = {
    "op10_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
