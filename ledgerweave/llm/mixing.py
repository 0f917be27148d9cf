"""Mixing sources to target weights: targets by weight, blocks by Sainte-Lague apportionment, a seeded choice of blocks.

A source's documents are dealt to shards by a seeded hash and make one run of words in each, in the order of that hash. A
shard's run is cut into blocks of equal numbers of words. Sainte-Lague gives every source a whole number of blocks, and
every shard of a source its quota of these; within a shard the blocks are chosen by a systematic draw with a seeded start,
so each is taken floor(quota / blocks) times or once more. No task sorts more than one shard's narrow rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_short, broadcast_if_small, discard, text_mark, written

WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, and the most that a source (and so a document) is repeated.
SHARE, REPEATS = (3, 2), 2
#: Words of a block: at most this many, fewer where that makes under BLOCKS_A_SOURCE blocks for each source on average.
BLOCK, BLOCKS_A_SOURCE = 256, 1000
#: Shards of all sources together, about (a source has one at least), and the fewest words that are worth a shard.
SHARDS, SHARD_WORDS = 4096, 1 << 16
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: int, *parts: Column) -> Column:
    """A number of 60 bits from md5 over the seed and the parts."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def reached(sources: DataFrame, share: tuple[int, int], repeats: int) -> tuple[int, int]:
    """(a, b) of the level a / b: a source's target is its weight times the level, or repeats times its size if that is less.

    What sources of a full target leave over is shared by weight among the others until none is above; each pass over the
    table of sources brings two sums to the driver.
    """
    total = int(sources.agg(F.sum(F.col("size").cast("decimal(38,0)"))).first()[0] or 0)
    a, b = 0, 1
    while True:
        full = F.col("size").cast("decimal(38,0)") * (repeats * b) <= F.col("weight").cast("decimal(38,0)") * a
        row = sources.agg(F.sum(F.when(full, F.col("size").cast("decimal(38,0)"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return a, b
        new = share[0] * total - share[1] * repeats * int(row["full"] or 0), share[1] * int(row["weight"])
        shorter = math.gcd(*new) or 1
        new = new[0] // shorter, new[1] // shorter
        if new == (a, b):
            return a, b
        a, b = new


def apportioned(parties: DataFrame, seats: DataFrame) -> DataFrame:
    """parties (grp, party, votes, most) with quota: the seats of each group (grp, seats) by highest quotients votes / (2 j + 1).

    No party gets more than most seats; equal quotients go to the smaller party. Seats that a divisor somewhat above the
    final one gives are won; of the next ones, some three a party, the highest quotients take what is left. A group needs
    sum(most) >= seats.
    """
    given = lambda divisor: F.least("most", F.floor(F.col("votes") / divisor + 0.5)).cast("long")
    own = Window.partitionBy("grp")
    each = parties.join(seats, "grp").withColumns({"total": F.sum(F.col("votes").cast("decimal(38,9)")).over(own).cast("double"), "n": F.count(F.lit(1)).over(own)})
    # the divisor below the final one: of the smallest lead at which the seats suffice in spite of the bounds
    leads = range(6)
    won = F.when(F.col("seats") > F.col("n"), given(F.col("total") / (F.col("seats") - F.col("n")))).otherwise(F.lit(0).cast("long"))
    each = each.withColumns({"won": won} | {f"end{k}": given(F.col("total") / (F.col("seats") + F.col("n") * (1 << 4 * k))) for k in leads})
    each = each.withColumns({"left": F.col("seats") - F.sum("won").over(own)} | {f"sum{k}": F.sum(f"end{k}").over(own) for k in leads})
    end = F.coalesce(*[F.when(F.col(f"sum{k}") >= F.col("seats"), F.col(f"end{k}")) for k in leads], F.col("most"))
    each = written(each.select("grp", "party", "votes", "won", "left", end.alias("end")), "seats")
    next_ones = each.where("end > won").select("grp", "party", "votes", "left", F.explode(F.sequence("won", F.col("end") - 1)).alias("j"))
    next_ones = next_ones.withColumn("quotient", F.col("votes") / (2 * F.col("j") + 1))
    order = Window.partitionBy("grp").orderBy(F.col("quotient").desc(), "party")
    more = next_ones.withColumn("place", F.row_number().over(order)).where("place <= left").groupBy("grp", "party").agg(F.count(F.lit(1)).alias("more"))
    return each.join(more, ["grp", "party"], "left").select("grp", "party", (F.col("won") + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS,
    block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """For every row of docs (doc_id, text, source): doc_id, mark, source, size, source_size, target, shard, taken, spans.

    size counts words; weights repeat over the sources in the order of code points, null last. The mix has share of all
    words. spans lists what the mix takes of the document: (start, length, times), in words; taken adds them up. mark is
    the text's hash, which tells rows of one doc_id apart in `cut_texts`.

    A block has about `block` words (see BLOCK), so a source's taken words are within a block of its target. The table of
    sources, one row each, and the shards of one source are small next to documents and are ranked in one task each.

    Defined cases: a null text has no words; a null source is a source of its own; documents and sources without words are
    taken 0 times; rows that repeat a doc_id count each for itself; an empty table gives an empty result; other columns
    are ignored.
    """
    if repeats * share[1] < share[0]:
        raise ValueError("the share of all words is above what the repeats allow")
    text = F.col("text")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"), text_mark(text).alias("mark"))
    sized = written(sized.withColumn("draw", drawn(seed, F.col("doc_id"))), "sizes")
    ranks = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("size")).withColumn("sid", (F.row_number().over(ranks) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "sources")
    a, b = reached(sources, share, repeats)
    full = F.col("size").cast("decimal(38,0)") * (repeats * b) <= F.col("weight").cast("decimal(38,0)") * a
    totals = sources.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).first()
    all_words = int(totals["words"] or 0)
    shard_words = max(SHARD_WORDS, -(-all_words // shards))
    words = max(1, min(block, share[0] * all_words // (share[1] * BLOCKS_A_SOURCE * max(1, totals["n"]))))
    target = F.when(full, (F.col("size") * repeats).cast("double")).otherwise((F.col("weight") * F.lit(a)).cast("double") / F.lit(float(b)))
    named = sources.select(
        F.col("source").alias("named"), "sid", F.col("size").alias("source_size"), target.alias("target"), full.alias("full"),
        F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(shard_words))).cast("long").alias("shards"),
    )
    named = broadcast_if_short(named, "named")
    placed = sized.join(named, sized["source"].eqNullSafe(named["named"])).drop("named").withColumn("shard", F.col("draw") % F.col("shards"))
    cells = placed.groupBy("sid", "shard").agg(F.sum("size").alias("cell_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("full").alias("full"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("cell_words") / words + 0.5)).cast("long")
    cells = written(cells.where("cell_words > 0").withColumn("blocks", blocks), "cells")
    per = cells.groupBy("sid").agg(F.sum("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("full").alias("full"))
    # a target in the source's own blocks; of a full one it is whole
    votes = F.col("target") * F.col("blocks") / F.col("source_size")
    per = per.select(F.lit(0).alias("grp"), F.col("sid").alias("party"), votes.alias("votes"), (F.col("blocks") * repeats).alias("most"), "full")
    per = written(per, "parties")
    free = per.where("not full")
    seats = free.agg(F.floor(F.sum(F.col("votes").cast("decimal(38,9)")) + F.lit(0.5).cast("decimal(2,1)")).cast("long").alias("seats")).select(F.lit(0).alias("grp"), "seats")
    quotas = apportioned(free.drop("full"), seats).select("party", "quota").unionByName(per.where("full").select("party", F.col("most").alias("quota")))
    inner = cells.select(F.col("sid").alias("grp"), F.col("shard").alias("party"), F.col("blocks").cast("double").alias("votes"), (F.col("blocks") * repeats).alias("most"))
    shares = apportioned(inner, quotas.select(F.col("party").alias("grp"), F.col("quota").alias("seats")))
    cells = cells.join(shares.select(F.col("grp").alias("sid"), F.col("party").alias("shard"), "quota"), ["sid", "shard"])
    cells = written(cells.select("sid", "shard", "cell_words", "blocks", "quota", (drawn(seed, F.col("sid"), F.col("shard")) % F.col("blocks")).alias("start")), "quotas")
    rows = placed.join(broadcast_if_small(cells), ["sid", "shard"], "left")
    # rows without words take no place in a run, so each is a group of its own
    run = Window.partitionBy("sid", "shard", F.when(F.col("size") == 0, F.col("draw"))).orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hi", F.sum("size").over(run)).withColumn("lo", F.col("hi") - F.col("size"))
    spans = F.expr("""
        CASE WHEN size > 0 THEN filter(
          transform(
            sequence(((lo + 1) * blocks - 1) div cell_words, (hi * blocks - 1) div cell_words),
            j -> named_struct(
              'start', greatest(lo, j * cell_words div blocks) - lo,
              'length', least(hi, (j + 1) * cell_words div blocks) - greatest(lo, j * cell_words div blocks),
              'times', quota div blocks + ((j + 1) * (quota % blocks) + start) div blocks - (j * (quota % blocks) + start) div blocks)),
          s -> s.times > 0)
        ELSE cast(array() AS array<struct<start: bigint, length: bigint, times: bigint>>) END""")
    rows = rows.withColumn("spans", spans)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"] * s["times"])
    discard(per)
    return rows.select("doc_id", "mark", "source", "size", "source_size", "target", "shard", taken.alias("taken"), "spans")


def cut_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, source, shard, start, copy, text: the mix itself, one row for each span and each time that it is taken.

    A span's words are joined by single spaces. Rows that are alike in doc_id and text are interchangeable.
    """
    alike = Window.partitionBy("doc_id", "mark").orderBy("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text").withColumn("turn", F.row_number().over(alike))
    taken = mixed.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("source", "shard", "taken"))).where("taken > 0")
    same = texts["doc_id"].eqNullSafe(taken["doc_id"]) & (texts["mark"] == taken["mark"]) & (texts["turn"] == taken["turn"])
    both = taken.join(texts, same).select(taken["doc_id"], "source", "shard", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.explode("spans").alias("s"))
    both = both.select("doc_id", "source", "shard", "words", "s", F.explode(F.sequence(F.lit(1), F.col("s.times"))).alias("copy"))
    piece = F.array_join(F.slice("words", (F.col("s.start") + 1).cast("int"), F.col("s.length").cast("int")), " ")
    return both.select("doc_id", "source", "shard", F.col("s.start").alias("start"), F.col("copy").cast("int").alias("copy"), piece.alias("text"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op12_source_mixing": rf"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents
), sources AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source)
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY size / weight, sid ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
    sum(weight) OVER (ORDER BY size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS live
  FROM sources
), level AS (
  SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT 3 * total - 4 * before AS a, 2 * live AS b, size / weight AS ratio, sid FROM ordered WHERE 4 * size * live > weight * (3 * total - 4 * before))
  ORDER BY ratio, sid LIMIT 1
), parts AS MATERIALIZED (
  SELECT sources.*, coalesce(2 * size * b <= weight * a, TRUE) AS is_full,
    CASE WHEN 2 * size * b > weight * a THEN CAST(weight * (a // gcd(a, b)) AS DOUBLE) / CAST(b // gcd(a, b) AS DOUBLE) ELSE CAST(2 * size AS DOUBLE) END AS target,
    greatest(1, CAST(ceil(size / greatest({SHARD_WORDS}, (total + {SHARDS - 1}) // {SHARDS})) AS BIGINT)) AS shards
  FROM (SELECT *, CAST(sum(size) OVER () AS BIGINT) AS total FROM sources) AS sources LEFT JOIN level ON TRUE
), block AS (SELECT greatest(1, least({BLOCK}, 3 * sum(size) // (2 * {BLOCKS_A_SOURCE} * count(*)))) AS words FROM sources
), cells AS MATERIALIZED (
  SELECT sid, draw % shards AS shard, CAST(sum(sized.size) AS BIGINT) AS cell_words, greatest(1, CAST(floor(sum(sized.size) / any_value(words) + 0.5) AS BIGINT)) AS blocks
  FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source, block GROUP BY ALL HAVING sum(sized.size) > 0
), party AS MATERIALIZED (
  SELECT sid, is_full, target * sum(blocks)::BIGINT / size AS votes, 2 * sum(blocks)::BIGINT AS most
  FROM cells JOIN parts USING (sid) GROUP BY sid, is_full, target, size
), outer_quota AS MATERIALIZED (
  SELECT sid, count(*) AS quota FROM (
    SELECT sid, row_number() OVER (ORDER BY votes / (2 * j + 1) DESC, sid) AS place
    FROM (SELECT sid, votes, unnest(range(0, most)) AS j FROM party WHERE NOT is_full))
  WHERE place <= (SELECT CAST(floor(sum(votes::DECIMAL(38, 9)) + 0.5) AS BIGINT) FROM party WHERE NOT is_full) GROUP BY sid
  UNION ALL SELECT sid, most FROM party WHERE is_full
), quotas AS MATERIALIZED (
  SELECT cells.*, coalesce(quota, 0) AS quota, CAST('0x' || substr(md5('{SEED}:' || sid || ':' || shard), 1, 15) AS BIGINT) % blocks AS start
  FROM cells LEFT JOIN (
    SELECT sid, shard, count(*) AS quota FROM (
      SELECT sid, shard, quota, row_number() OVER (PARTITION BY sid ORDER BY blocks::DOUBLE / (2 * j + 1) DESC, shard) AS place
      FROM (SELECT sid, shard, blocks, quota, unnest(range(0, 2 * blocks)) AS j FROM cells JOIN outer_quota USING (sid)))
    WHERE place <= quota GROUP BY ALL) USING (sid, shard)
), laid AS MATERIALIZED (
  SELECT doc_id, sized.size, parts.size AS source_size, target, sid, draw % shards AS shard,
    sum(sized.size) OVER (PARTITION BY sid, draw % shards ORDER BY draw, doc_id NULLS LAST, sized.size ROWS UNBOUNDED PRECEDING)::BIGINT AS till
  FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source
), pieces AS (
  SELECT sid, shard, j * cell_words // blocks AS lo, (j + 1) * cell_words // blocks AS hi,
    quota // blocks + ((j + 1) * (quota % blocks) + start) // blocks - (j * (quota % blocks) + start) // blocks AS times
  FROM (SELECT *, unnest(range(0, blocks)) AS j FROM quotas)
), hits AS (
  SELECT laid.doc_id, laid.sid, laid.shard, till, sum(times * (least(till, hi) - greatest(till - size, lo))) AS taken
  FROM laid JOIN pieces ON laid.sid = pieces.sid AND laid.shard = pieces.shard AND lo < till AND hi > till - size WHERE size > 0 GROUP BY ALL
)
SELECT laid.doc_id, laid.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM laid LEFT JOIN hits ON laid.size > 0 AND laid.sid = hits.sid AND laid.shard = hits.shard AND laid.till = hits.till"""
}
