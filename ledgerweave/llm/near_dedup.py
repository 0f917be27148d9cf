"""MinHash near-dedup with tensored banding.

Two small collections of sub-keys are formed, each sub-key from ROWS minhashes; a table's key is a pair of one sub-key of
either collection. 2 x groups sub-keys thus make groups ** 2 tables. A pair of similarity s shares no key with probability
at most 2 (1 - s ** rows) ** groups; bands() takes as many groups as keep that under MISS: 5.5e-6 at 0.85 with 10 groups of
2, 3.4e-6 at 0.80 with 13 groups of 2.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, discard, slices, text_mark, with_package, without_rows, written

WORDS = 5
#: Links need 100 * intersection >= percent * union: op8's contract, and what the pipeline's stage uses.
PERCENT = 85
STAGE_PERCENT = 80
#: Probability of missing a pair at the threshold, at most; where more groups would be needed, sub-keys are of one minhash, not two.
MISS = 6e-6
MOST_GROUPS = 13
SEED = 20240229
#: Bits of a parity sketch: each shingle flips one, so two sketches differ in at most as many bits as their sets in elements.
SKETCH_BITS = 1024
#: Word hashes that a Python worker remembers.
MEMO_WORDS = 200_000
#: Where more pairs than this would be compared in a bucket, its members are compared by their rarest shingles instead.
BUCKET_PAIRS = 2_000_000
#: Where more pairs than this are left between a bucket's parts, all its members are compared with some of them, in turns: with
#: FEWEST_PIVOTS, then twice as many each time, MOST_PIVOTS at most.
CROWD_PAIRS, FEWEST_PIVOTS, MOST_PIVOTS = 10_000, 4, 32
#: A bucket gets another turn if the last one left it at most this share of its pairs.
WORTHWHILE = 0.9
#: Shingles multiplied at once, so that a block stays in a core's cache.
BLOCK = 1024

SKETCH = [f"p{k}" for k in range(SKETCH_BITS // 64)]


def bands(percent: int) -> tuple[int, int]:
    """(groups, rows) of the sub-keys for a threshold."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be within 1 and 100, not {percent}")
    for rows in (2, 1):
        alike = (percent / 100) ** rows
        groups = 1
        while 2 * (1 - alike) ** groups > MISS:
            groups += 1
        if groups <= MOST_GROUPS:
            break
    return groups, rows


GROUPS, ROWS = bands(PERCENT)


def sub_keys(groups: int) -> list[str]:
    return [f"{side}{k}" for side in "ab" for k in range(groups)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles; the whole sequence is one if it is shorter.

    bytes.lower() and bytes.split() change and cut at exactly the ASCII letters and white space.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def seeds(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each multiplier's hash, all multipliers over a block of shingles at once."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), BLOCK):
        x = multipliers[:, None] * shingles[None, lo : lo + BLOCK]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def signature(shingles: np.ndarray, multipliers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The words of the parity sketch, then the sub-keys."""
    parts = minhashes(shingles, multipliers).reshape(-1, rows)
    keys = parts[:, 0]
    for k in range(1, rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    at = (mixed(shingles ^ np.uint64(SEED)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.concatenate([np.packbits(parity).view(">i8").astype(np.int64), keys.view(np.int64)])


def set_hash(shingles: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes(), SEED), dtype=">i8").tolist()


def with_mark(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, the set's 128-bit hash, its sketch and sub-keys, for every row of docs."""
    with_package(docs.sparkSession)
    groups, size = bands(percent)
    marks = SKETCH + sub_keys(groups)
    names = ["doc_id", "mark", "n_shingles", "set_hi", "set_lo", *marks]

    def run(batches):
        hashes, multipliers = WordHashes(), seeds(2 * groups * size)
        for batch in slices(batches):
            out = np.zeros((batch.num_rows, 3 + len(marks)), dtype=np.int64)
            for row, text in zip(out, batch.column(2).to_pylist(), strict=True):
                shingles = shingle_set(text, hashes)
                if len(shingles):
                    row[0] = len(shingles)
                    row[1:3] = set_hash(shingles)
                    row[3:] = signature(shingles, multipliers, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.T.copy())], names)

    return with_mark(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def shared_sub_keys(classes: DataFrame, groups: int) -> DataFrame:
    """(cls, rank, s): the sub-keys (at, value) of each class that another class has too; at most 2 * groups of them.

    rank orders classes by the likelihood that others were copied from them: most rows first, then the smallest doc_id.
    """
    rank = F.struct((-F.col("size")).alias("size"), F.col("best.none").alias("none"), F.col("best.id").alias("id"), "cls").alias("rank")
    subs = classes.select(
        rank, F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.col(c).alias("value")) for k, c in enumerate(sub_keys(groups))])).alias("s")
    ).select("rank", "s.at", "s.value")
    often = subs.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "value")
    often = written(often, "subkeys")
    kept = subs.join(broadcast_if_small(often), ["at", "value"], "left_semi")
    lists = kept.groupBy("rank").agg(F.collect_list(F.struct("at", "value")).alias("s"))
    lists = written(lists.select("rank.cls", "rank", "s"), "sublists")
    discard(often)
    return lists


def table_keys(lists: DataFrame, groups: int) -> DataFrame:
    """(key, rank, cls) of the tables' keys that a class can share with another: pairs of sub-keys that are both shared."""
    one = F.filter("s", lambda x: x["at"] < groups)
    two = F.filter("s", lambda x: x["at"] >= groups)
    both = lists.select("rank", F.explode(one).alias("a"), two.alias("two")).select("rank", "a", F.explode("two").alias("b"))
    return both.select(F.xxhash64("a.at", "a.value", "b.at", "b.value").alias("key"), "rank", "rank.cls")


def likely(a: str, b: str, percent: int):
    """Whether two classes' sizes and sketches let them be similar enough.

    Linked sets of n and m elements differ in at most d = (100 - percent) (n + m) / (100 + percent) elements, and their
    sketches in no more bits, so nothing linked is lost by that bound. Where sets are large against the sketch, the bits
    expected at d plus six standard deviations are a lower bound still.
    """
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in SKETCH])
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    most = F.floor((small + large) * (100 - percent) / (100 + percent))
    odd = (1 - F.exp(-2.0 * most / SKETCH_BITS)) / 2
    usual = SKETCH_BITS * odd + 6 * F.sqrt(SKETCH_BITS * odd * (1 - odd))
    return (small * 100 >= large * percent) & (bits <= F.least(most, usual))


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, shingles): the full shingle sets of the classes in ids, from one row of each, as a written table; rows may repeat."""
    wanted = classes.select("cls", F.col("best.id").alias("rep"), F.col("best.mark").alias("rep_mark")).join(ids, "cls", "left_semi")
    wanted = written(wanted, "wanted")
    text, small = with_mark(docs), broadcast_if_small(wanted)
    text = text.join(small, text["doc_id"].eqNullSafe(small["rep"]) & (text["mark"] == small["rep_mark"])).select("cls", "text")

    def sets(batches):
        hashes, seen = WordHashes(), set()
        for batch in slices(batches):
            fresh = []
            for at, cls in enumerate(batch.column(0).to_pylist()):
                if cls not in seen:  # rows repeated as a whole
                    fresh.append(at)
                    seen.add(cls)
            if len(seen) > 100_000:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            made = [shingle_set(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["cls", "shingles"])

    held = written(text.mapInArrow(sets, "cls long, shingles binary"), "sets")
    discard(wanted)
    return held


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough. Sets are made of one row of each class."""
    pairs = written(pairs, "pairs")
    held = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    once = held.dropDuplicates(["cls"])
    both = pairs.join(once.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(once.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                common = int((np.searchsorted(x, y, side="right") - np.searchsorted(x, y)).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(both.mapInArrow(compare, "a long, b long"), "links")
    discard(pairs, held)
    return links


def sides(p: str) -> list:
    return [F.col(c).alias(p if c == "cls" else f"{p}_{c}") for c in ("cls", "part", "n", *SKETCH)]


def rare_pairs(docs: DataFrame, classes: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of likely classes of different parts among the members (cls, part, n, sketch), by their rarest shingles.

    In one order of all the members' shingles, from the rarest on, sets that are similar enough share one of their first
    n - ceil(n * percent / 100) + 1, so no pair is missed, whatever the members have in common.
    """
    held = sets_of(docs, classes, member.select("cls"))

    def each(batches):
        for batch in slices(batches, 64):
            sets = [np.frombuffer(v, np.int64) for v in batch.column(1).to_pylist()]
            cls = np.repeat(batch.column(0).to_numpy(), [len(v) for v in sets])
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(sets))], ["cls", "x"])

    single = written(held.dropDuplicates(["cls"]).mapInArrow(each, "cls long, x long"), "shingles")
    often = single.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("cls").orderBy("often", "x")
    first = single.join(often, "x").withColumn("at", F.row_number().over(order)).join(member, "cls")
    first = first.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("often") > 1)).select("x", "cls", "part", "n", *SKETCH)
    first = written(first, "rarest")
    one, two = (first.select("x", *sides(p)) for p in "ab")
    near = one.join(two, (one["x"] == two["x"]) & (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & likely("a", "b", percent))
    out = written(near.select("a", "b").distinct(), "rare")
    discard(held, single, first)
    return out


def pairs_left(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, pairs) of each bucket: its members times those outside its largest part. parts: vertex, component."""
    sizes = with_parts(buckets, parts).groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("own")).select("key", (F.col("all") * (F.col("all") - F.col("own"))).alias("pairs"))


def with_parts(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """key, cls and part of each member: its component, or itself where it has none."""
    member = buckets.join(parts.withColumnRenamed("vertex", "cls"), "cls", "left")
    return member.select("key", "cls", F.coalesce("component", "cls").alias("part"))


def pivot_pairs(member: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of likely classes of different parts, one of which is a pivot of their bucket in this turn.

    member: key, cls, part, n, sketch. Pivots are the first in orders of all classes, so a crowd that meets in many tables
    has few of them, and its pairs are as many as its members times a few.
    """
    many = min(FEWEST_PIVOTS << turn, MOST_PIVOTS)
    firsts = [F.min(F.struct(F.xxhash64("cls", F.lit(MOST_PIVOTS * turn + k)).alias("at"), "cls"))["cls"] for k in range(many)]
    pivots = member.groupBy("key").agg(F.array_distinct(F.array(*firsts)).alias("cls")).select("key", F.explode("cls").alias("cls"))
    pivots = written(member.join(broadcast_if_small(pivots), ["key", "cls"], "left_semi").select("key", *sides("a")), "pivots")
    every = member.select("key", *sides("b"))
    near = every.join(broadcast_if_small(pivots), (every["key"] == pivots["key"]) & (F.col("a_part") != F.col("b_part")) & likely("a", "b", percent))
    found = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pivoted")
    discard(pivots)
    return found


def best_centers(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class b that isn't first in all its buckets and, of their first classes, that which it meets in most tables.

    One pair for each class at most, however many buckets it is in; of centers met as often the likeliest original counts.
    """
    met = buckets.where("cls <> center").groupBy("cls", "center").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    best = met.groupBy("cls").agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("best"))
    return best.select(F.col("best.first.cls").alias("a"), F.col("cls").alias("b"))


def contracted(docs: DataFrame, classes: DataFrame, buckets: DataFrame, star: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, parts, compared): the links among the pairs of star and of the pivots' turns, their components, all those pairs.

    One member need not be similar enough to most of a large group of near copies, whose others would then be compared in
    pairs. So buckets with many pairs left between their parts take turns: all their members are compared with a few
    pivots and links are contracted, for as long as that takes away a good share of a bucket's pairs.
    """
    compared = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(docs, classes, star, percent)
    facts = classes.select("cls", "n", *SKETCH)
    before, turn = None, 0
    while True:
        parts = connected_components(links)
        left = pairs_left(buckets, parts).where(F.col("pairs") > CROWD_PAIRS)
        if before is not None:
            was = before.select("key", F.col("pairs").alias("was"))
            left = left.join(was, "key").where(F.col("pairs") <= WORTHWHILE * F.col("was")).drop("was")
        left = written(left, "left")
        if left.isEmpty():
            return links, parts, compared
        crowd = buckets.join(broadcast_if_small(left.select("key")), "key", "left_semi")
        crowd = written(with_parts(crowd, parts).join(facts, "cls"), "crowd")
        near = pivot_pairs(crowd, turn, percent)
        near = written(near.join(compared, ["a", "b"], "left_anti"), "turn")
        more = verified(docs, classes, near, percent)
        discard(crowd, before)
        if more.isEmpty():
            return links, parts, compared.unionByName(near)
        links, compared = links.unionByName(more), compared.unionByName(near)
        before, turn = left, turn + 1


def cross_pairs(docs: DataFrame, classes: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of likely classes of different parts that meet in a bucket; member: key, cls, part, n, sketch.

    Members of a bucket's lowest part are compared with those of the others only. The members of buckets where that would
    still be many pairs are compared by their rarest shingles, which misses none of those pairs.
    """
    sizes = member.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("c").alias("all"), F.min_by("c", "part").alias("own"))
    sizes = sizes.where("low < high").select("key", "low", ((F.col("all") - F.col("own")) * F.col("all") > BUCKET_PAIRS).alias("many"))
    sizes = written(sizes, "mixed")
    member = written(member.join(sizes, "key"), "members")
    few = member.where("not many")
    other = few.where(F.col("part") != F.col("low")).select("key", *sides("a"))
    every = few.select("key", "low", *sides("b"))
    once = (F.col("b_part") == F.col("low")) | (F.col("a") < F.col("b"))
    cross = other.join(every, (other["key"] == every["key"]) & (F.col("a_part") != F.col("b_part")) & once & likely("a", "b", percent))
    found = written(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross")
    many = member.where("many")
    if not many.isEmpty():
        many = written(many.select("cls", "part", "n", *SKETCH).distinct(), "many")
        found = found.unionByName(rare_pairs(docs, classes, many, percent)).distinct()
    return found


def near_rows(docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, mark, n_shingles, component_id, best, size of every row of docs; the tables it reads).

    best names the row that stays of a component: none (whether its doc_id is null), id, mark. size counts its rows.
    """
    marks = written(signatures(docs, percent), "signatures")
    groups, _ = bands(percent)
    full = marks.where("n_shingles > 0")
    same = [F.min(c).alias(c) for c in (*SKETCH, *sub_keys(groups))]  # equal within a class
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    classes = full.groupBy("set_hi", "set_lo").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size"), F.min("n_shingles").alias("n"), *same)
    # numbered as written: ids of one table never repeat, whichever attempt of a task has written its part
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lists = shared_sub_keys(classes, groups)
    keys = written(table_keys(lists, groups), "keys")
    heads = keys.groupBy("key").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select("key", "first", F.col("first.cls").alias("center"))
    buckets = written(keys.drop("rank").join(heads, "key"), "buckets")
    discard(keys)
    facts = classes.select("cls", "n", *SKETCH)
    named = lambda p: facts.select(*[F.col(c).alias(p if c == "cls" else f"{p}_{c}") for c in facts.columns])
    star = best_centers(buckets)
    star = written(star.join(named("a"), "a").join(named("b"), "b").where(likely("a", "b", percent)).select("a", "b"), "star")
    links, parts, compared = contracted(docs, classes, buckets, star, percent)
    cross = cross_pairs(docs, classes, with_parts(buckets, parts).join(facts, "cls"), percent)
    cross = cross.join(compared, ["a", "b"], "left_anti")
    parts = connected_components(links.unionByName(verified(docs, classes, cross, percent))).withColumnRenamed("vertex", "cls")
    parts = written(classes.select("set_hi", "set_lo", "cls", "best", "size").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "parts")
    least = parts.groupBy("component").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    parts = written(parts.select("set_hi", "set_lo", "component").join(least, "component"), "components").drop("component")
    discard(classes, lists, buckets, star, links)
    found = marks.select("doc_id", "mark", "n_shingles", "set_hi", "set_lo").join(parts, ["set_hi", "set_lo"], "left").drop("set_hi", "set_lo")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("best.id"))
    return found.withColumn("component_id", component), [marks, parts]


def near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; texts link from a similarity of percent / 100.

    Rows with equal shingle sets form a class, which one row of it represents; only classes are compared. Each
    is first compared with one class, of the likeliest originals of its tables' buckets that which it meets most often, in
    crowded buckets then with a few pivots in turns; the links found are contracted, and then only members of different
    components are compared with each other, so that no link between components is lost and a bucket of copies makes few
    pairs for each of its members. Members of buckets with many unlike ones are compared by their rarest shingles, which finds
    the same pairs and those between such buckets. Sketches and sizes rule out unlike pairs inside the joins, before the
    full sets confirm the rest.

    Defined cases: null and empty texts and such without words have an empty set and are their own component; a text of
    fewer than five words is one shingle; equal rows link; rows of one doc_id with different texts are documents of their
    own, each with the component of its text; a null doc_id links like any other but is never the smallest, and a
    component of null ids alone has a null component_id; other columns are ignored.
    """
    found, _ = near_rows(docs, percent)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; all columns stay as they are.

    Defined cases: rows are dropped one by one, so a doc_id's other texts stay; of rows equal in doc_id and text one
    stays; a null doc_id loses to any other and is dropped like any other; texts without words are never dropped.
    """
    found, tables = near_rows(docs, percent)
    best = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    texts = found.where("size > 1").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("once"))
    left = without_rows(docs, texts.where("not once or n > 1").select("doc_id", "mark", "once"))
    discard(*tables)
    return left


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), PERCENT)


ORACLE = {
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), g AS (
  SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS x
  FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), f AS (SELECT DISTINCT doc_id, x FROM g WHERE i <= greatest(1, n - 4)
), k AS (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS s, count(*) AS n FROM f GROUP BY doc_id
), s AS (SELECT doc_id, s, coalesce(n, 0) AS n FROM documents LEFT JOIN k USING (doc_id)
), c AS (SELECT min(doc_id) AS rep, s, min(n) AS n FROM k GROUP BY s
), e AS (SELECT rep, n, x FROM c JOIN f ON f.doc_id = c.rep
), p AS (
  SELECT a.rep AS a, b.rep AS b, a.n + b.n AS n, count(*) AS both_n FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * both_n >= 85 * (n - both_n) UNION ALL SELECT b, a FROM p WHERE 100 * both_n >= 85 * (n - both_n)
), reach AS (
  SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), part AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN c USING (s) LEFT JOIN part USING (rep)"""
}
