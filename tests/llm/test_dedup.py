"""Exact dedup, near dedup, embeddings and sharding against brute force, awkward rows included."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from ledgerweave.llm import embeddings, exact_dedup, near_dedup, sharding
from ledgerweave.llm.common import connected_components
from pyspark.sql import functions as F

from .conftest import awkward_rows, words


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("digests", [True, False])
def test_exact(spark, docs, digests):
    got = exact_dedup.exact_duplicates(docs, digests=digests).collect()
    norm = [(r[0], re.sub(r"[ \t-\r]+", " ", r[1] or "")) for r in awkward_rows()]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        if digests or len(groups[t]) > 1:
            want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(tuple(r) for r in got) == Counter(want)


def rank(row):
    return row[0] is None, row[0] or 0


def test_exact_drop_keeps_columns_and_first_rows(docs):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    groups = {}
    for row in sorted(awkward_rows(), key=rank):
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", row[1] or ""), row[0])
    assert Counter(r.doc_id for r in left.collect()) == Counter(groups.values())


#: (doc_id, text): ids with several texts, rows repeated as a whole, null ids, texts that differ in white space alone.
ROWS_OF_ONE_ID = [
    (1, "same text"), (2, "same text"), (2, "unique other text"), (3, "twice"), (3, "twice"), (None, "same text"), (None, "of no id"), (None, "of no id"),
    (4, "a  b"), (4, "a b"), (5, None), (5, ""), (6, "twice"), (7, "unique"),
]
CLASHING = "doc_id long, text string, __gone long, __id long, shard string, mark long, once boolean, cls long, best string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, k, k, "mine", k, True, k, "b") for k, (i, t) in enumerate(rows)], CLASHING)


def test_exact_drop_decides_row_by_row(spark):
    left = exact_dedup.drop_exact_duplicates(clashing(spark, ROWS_OF_ONE_ID))
    assert left.columns == [c.split()[0] for c in CLASHING.split(", ")]
    got = Counter((r.doc_id, re.sub(" +", " ", r.text or "")) for r in left.collect())
    assert got == Counter([(1, "same text"), (2, "unique other text"), (3, "twice"), (None, "of no id"), (4, "a b"), (5, ""), (7, "unique")])


def brute_near(rows, percent=85):
    """The set of each row, and the number of each row's component."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links = [(a, b) for a, (_, s) in enumerate(sets) for b, (_, t) in enumerate(sets[:a]) if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return sets, components(range(len(rows)), links)


def smallest_ids(rows, percent=85):
    sets, part = brute_near(rows, percent)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[part[k]] = min(rows[k][0], least.get(part[k], rows[k][0]))
    return [(i, len(s), least.get(part[k])) for k, (i, s) in enumerate(sets)], part


@pytest.mark.parametrize("rows", [[r[:2] for r in awkward_rows()], ROWS_OF_ONE_ID])
def test_near_awkward(spark, rows):
    got = near_dedup.near_duplicates(clashing(spark, rows), 85).collect()
    want = [(i, n, least, i == least) for i, n, least in smallest_ids(rows)[0]]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_near_drop_decides_row_by_row(spark):
    rows = [(i, t and " ".join(f"{t} {w}" for w in "a b c d e f g h".split())) for i, t in ROWS_OF_ONE_ID]
    left = near_dedup.drop_near_duplicates(clashing(spark, rows))
    assert left.columns == [c.split()[0] for c in CLASHING.split(", ")]
    part = brute_near(rows, 80)[1]
    best = {}
    for k in sorted(range(len(rows)), key=lambda k: rank(rows[k])):
        best.setdefault(part[k] if rows[k][1] else -k - 1, k)  # texts without words all stay
    want = Counter((rows[k][0], " ".join((rows[k][1] or "").split())) for k in best.values())
    assert Counter((r.doc_id, " ".join((r.text or "").split())) for r in left.collect()) == want


def test_near_chains_and_groups(spark):
    r = random.Random(5)
    rows, n = [], 0
    for group in range(6):
        base = words(120, 100 + group).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"edit{r.randint(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
            base = copy if r.random() < 0.3 else base  # chains: ends need not be alike
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: least for i, _, least in smallest_ids(rows)[0]}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_hot_buckets_are_compared_by_rare_shingles(spark, monkeypatch, percent):
    """Many documents share half of their shingles, and so buckets, without being alike; some have a near copy."""
    r = random.Random(8)
    common = words(90, 1)
    rows = []
    for k in range(120):
        own = words(70, 1000 + k).split()
        rows.append((k, f"{common} {' '.join(own)}"))
        if k % 3 == 0:
            own[r.randrange(70)] = "edited"
            rows.append((1000 + k, f"{common} {' '.join(own)}"))
    monkeypatch.setattr(near_dedup, "BUCKET_PAIRS", 5)
    calls = []
    plain = near_dedup.rare_pairs
    monkeypatch.setattr(near_dedup, "rare_pairs", lambda *a: calls.append(plain(*a)) or calls[-1])
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == {i: least for i, _, least in smallest_ids(rows, percent)[0]}
    assert len(set(got.values())) == 120 and calls


@pytest.mark.parametrize("limit", [-1, 3, 10**9])
def test_links_do_not_depend_on_how_buckets_are_compared(spark, monkeypatch, limit):
    """A passage that many share fills buckets with unlike texts; near copies among them link whatever the limit of a bucket."""
    passage = words(60, 4)
    rows = [(k, f"{words(8 + k % 30, 300 + k)} {passage}") for k in range(60)]
    rows += [(100 + k, t.replace("alpha", "omega", 1)) for k, t in rows[:30]] + [(200, passage), (201, passage + " x")]
    monkeypatch.setattr(near_dedup, "BUCKET_PAIRS", limit)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 80).collect()}
    assert got == {i: least for i, _, least in smallest_ids(rows, 80)[0]}
    assert len(set(got.values())) > 5


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_of_an_absent_text_are_contracted_by_pivots(spark, monkeypatch, percent):
    """Few of a group are similar enough to its first rows, most to one another: they must not be compared in pairs."""
    r, base = random.Random(8), words(150, 9).split()
    rows = []
    for k in range(150):
        own = list(base)
        for at in r.sample(range(150), (3 if percent == 80 else 2) if k < 20 else 1):
            own[at] = f"edit{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, words(100, 700 + k)) for k in range(20)]
    monkeypatch.setattr(near_dedup, "CROWD_PAIRS", 300, raising=False)
    made, plain = [], near_dedup.cross_pairs
    monkeypatch.setattr(near_dedup, "cross_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == {i: least for i, _, least in smallest_ids(rows, percent)[0]}
    assert made[0].count() < 5 * len(rows)


def test_each_class_is_first_compared_with_one_center(spark, monkeypatch):
    """A passage that takes up most of many texts puts each of them into buckets of many first classes."""
    rows = [(1, 9, 5), (2, 9, 5), (3, 9, 5), (4, 9, 3), (5, 9, 3), (1, 3, 3), (2, 5, 5), (6, 7, 3), (7, 7, 5)]
    table = spark.createDataFrame(rows, "key long, cls long, center long").withColumn("first", F.struct((-F.col("center")).alias("size"), F.col("center").alias("cls")))
    assert {tuple(r) for r in near_dedup.best_centers(table).collect()} == {(5, 9), (5, 7)}
    passage = words(40, 4).split()
    rows = [(k, f"{' '.join(words(6 + k % 9, 300 + k).split())} {' '.join(passage[k % 7 :])}") for k in range(150)]
    rows += [(1000 + k, f"{t} more") for k, t in rows[:40]]
    stars, facts, plain = [], [], near_dedup.best_centers
    monkeypatch.setattr(near_dedup, "best_centers", lambda x: (facts.append(x.where("cls <> center").select("cls", "center").distinct().count()), stars.append(plain(x)), stars[-1])[-1])
    counts, contract = [], near_dedup.contracted
    monkeypatch.setattr(near_dedup, "contracted", lambda *a: (counts.append(stars[0].count()), contract(*a))[-1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: least for i, _, least in smallest_ids(rows)[0]}
    assert counts[0] < len(rows) < facts[0]


def test_parity_sketch_never_exceeds_the_difference():
    hashes, seeds = near_dedup.WordHashes(), near_dedup.seeds(2 * near_dedup.GROUPS * near_dedup.ROWS)
    for k in range(20):
        a, b = (near_dedup.shingle_set(words(80 + k, s).encode(), hashes) for s in (k, k + 1))
        x, y = (np.array(near_dedup.signature(s, seeds)[: len(near_dedup.SKETCH)], dtype=np.int64) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_empty_tables(spark, no_docs):
    assert exact_dedup.exact_duplicates(no_docs, digests=True).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert sharding.assign_shards(no_docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(vectors).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 499), (7, 7)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 499: 499, 500: 499}


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centers = r.standard_normal((12, 16))
    rows = []
    for k in range(240):
        v = centers[k % 12] + r.standard_normal(16) * r.choice([0.05, 0.12, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], k % 2 if k % 17 else None))
    rows += [(300, rows[2][1], rows[2][2]), (301, rows[2][1], rows[2][2]), (302, None, 0), (303, [0.0] * 16, 0), (304, [1.0, None] * 8, 0), (305, [float("inf")] * 16, 0), (306, [1.0], 0), (307, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_vectors(df).collect()}
    good = {i: np.array(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    part = components([i for i, _, _ in rows], links)
    assert len(links) > 100
    assert got == {i: (degree[i], part[i]) for i, _, _ in rows}


@pytest.mark.parametrize("size", [1e-200, 1e200, 5e-324, 1.7e308, 1.0])
def test_embeddings_of_extreme_sizes(spark, size):
    rows = [(1, [size, size], 1), (2, [size, 0.0], 1), (3, [size, size * 0.999], 1), (4, [1.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (2, 1), 4: (2, 1)}


def test_first_shared_table(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(4)
    tables = embeddings.tables_for(embeddings.THRESHOLD)
    x = r.standard_normal((200, 8))
    y = x + 0.6 * r.standard_normal((200, 8))
    p, q = embeddings.packed_keys(x, tables), embeddings.packed_keys(y, tables)
    each = lambda v: np.stack([v.view("<u2").reshape(len(v), -1)[:, k // 3 * 4 + k % 3] for k in range(tables)], axis=1)
    same = each(p) == each(q)
    want = [int(row.argmax()) if row.any() else None for row in same]
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(p, q, strict=True))], "k int, a array<long>, b array<long>")
    got = df.select("k", embeddings.first_shared("a", "b", tables).alias("t"), *[embeddings.key_at("a", t).alias(f"k{t}") for t in range(tables)]).orderBy("k").collect()
    assert [row.t for row in got] == want and None in want and len(set(want)) > 10
    assert [[row[f"k{t}"] for t in range(tables)] for row in got] == each(p).tolist()


def test_embedding_copies_share_a_repeated_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]
    got = sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_shards_split_only_what_is_too_large(spark, docs):
    rows = [(k, "x" * (50 + k % 100)) for k in range(400)] + [(1000, "y" * 5000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=1000).collect()
    assert len(got) == 401
    sums, bits = defaultdict(int), {}
    for x in got:
        sums[x.shard] += x.n_bytes
        bits[x.doc_id] = format(int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:12], 16), "048b")
        assert bits[x.doc_id].startswith(x.shard) and x.depth == len(x.shard)
    size = {k: len(t) for k, t in rows}
    for x in got:
        assert x.shard_bytes == sums[x.shard]
        assert x.over_limit == (sums[x.shard] > 1000) == (x.doc_id == 1000)
        if x.depth:  # the bucket it came from was too large
            assert sum(n for k, n in size.items() if bits[k].startswith(x.shard[:-1])) > 1000
    same = sharding.assign_shards(docs, limit_bytes=100).collect()
    assert len(same) == len(awkward_rows())


def test_written_shards(spark, tmp_path):
    rows = [(k, "x" * (50 + k % 100)) for k in range(300)] + [(1000, "y" * 5000)] + [(7, f"row {k} " * 20) for k in range(60)] + [(None, None)]
    docs = clashing(spark, rows)
    name = sharding.write_shards(docs, f"file://{tmp_path}/out", limit_bytes=1000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert name == "shard_" and set(back.columns) == {*docs.columns, name}
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, "mine") for i, t in rows)
    sizes, folder = defaultdict(int), {}
    for r in back.collect():
        sizes[r[name]] += len(r.text or "")
        assert folder.setdefault(r.doc_id, r[name]) == r[name]
    assert {k for k, v in sizes.items() if v > 1000} <= {folder[1000], folder[7]}
    hot = [p for p in (tmp_path / "out" / f"{name}={folder[7]}").iterdir() if p.suffix == ".parquet"]
    assert hot  # as many files as tasks: a table this small makes one


def test_shards_of_a_skewed_table(spark):
    rows = [(k, "x" * 10) for k in range(64)] + [(500, "y" * 100_000)]
    got = {x.doc_id: x for x in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=100).collect()}
    assert len(got) == 65 and got[500].over_limit and got[500].depth == sharding.HASH_BITS
    sums = defaultdict(int)
    for x in got.values():
        sums[x.shard] += x.n_bytes
    assert all(x.shard_bytes == sums[x.shard] and (x.over_limit or x.shard_bytes <= 100) for x in got.values())


def test_same_results_without_broadcasts(spark, docs, monkeypatch):
    from ledgerweave.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_exact(spark, docs, True)
        test_exact(spark, docs, False)
        test_exact_drop_keeps_columns_and_first_rows(docs)
        test_exact_drop_decides_row_by_row(spark)
        test_near_awkward(spark, ROWS_OF_ONE_ID)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("percent", [80, 60])
def test_near_links_at_other_thresholds(spark, percent):
    r = random.Random(11)
    rows = []
    for group in range(8):
        base = words(500, 700 + group).split()
        for n_edits in (0, 7, 10, 12, 14, 20, 30):  # 10 scattered edits leave about 450 / 550
            copy = list(base)
            for at in r.sample(range(0, 500, 6), n_edits):
                copy[at] = f"edit{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: least for i, _, least in smallest_ids(rows, percent)[0]}
    assert want != {i: least for i, _, least in smallest_ids(rows)[0]}
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, percent).collect()} == want
    left = near_dedup.drop_near_duplicates(docs) if percent == 80 else near_dedup.drop_near_duplicates(docs, percent)
    assert {x.doc_id for x in left.collect()} == set(want.values())


def test_bands_keep_the_chance_of_a_miss():
    assert near_dedup.bands(85) == (10, 2)
    for percent in range(30, 101):
        groups, rows = near_dedup.bands(percent)
        assert 2 * (1 - (percent / 100) ** rows) ** groups <= 6e-6
