"""Language ID, quality and private data: held-out accuracy, brute force, awkward rows; then the pipeline."""

import random
import re

import numpy as np
import pytest
from ledgerweave.llm import language, private_data, quality
from pyspark.sql import functions as F

from .conftest import awkward_rows, words

SAMPLES = {"aa": "the and of to in that", "bb": "der die und das nicht ein", "cc": "él la que los una ción"}


@pytest.fixture
def spoken(spark):
    r = random.Random(2)
    rows = []
    for k in range(240):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join(r.choice(SAMPLES[lang].split()) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(spoken):
    got = language.identify(spoken, F.col("doc_id") % 4 == 2).join(spoken, "doc_id").where("held_out").collect()
    assert len(got) == 60
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs, no_docs):
    got = language.identify(docs, F.col("doc_id") == 3).collect()
    assert len(got) == len(awkward_rows())
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (0, 1, 2))
    assert by[3].held_out and not by[4].held_out
    assert language.identify(no_docs, F.lit(False)).count() == 0
    untaught = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def test_bundle_equals_the_sum_of_bound_vectors():
    held = language.vectors()
    grams = language.trigrams("abc déf, gh")
    one = held.bundle([grams, np.zeros(0, np.int64)], columns=3)
    assert (one[0] == sum(held[grams[k : k + 1]][0].astype(int) for k in range(len(grams)))).all()
    assert not one[1].any()


def graded(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = " ".join(f"{w}###" for w in words(30, k).split()) if bad else words(40, k) + "."
        rows.append((k, text))
        labels.append((k, 0 if bad else 1, 0))
    labels += [(1, None, 0), (None, 1, 0), (2, 0, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = graded(spark)
    got = quality.score_quality(docs, labels, quality.held_out_third()).where("held_out").collect()
    assert got
    assert all(r.predicted == (0 if r.doc_id % 5 == 0 else 1) for r in got)


def test_quality_edges(spark, docs, no_docs):
    _, labels = graded(spark)
    got = quality.score_quality(docs, labels, quality.held_out_third()).collect()
    assert len(got) == len(awkward_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(no_docs, labels, quality.held_out_third()).count() == 0
    none = quality.score_quality(docs, labels.where("false"), quality.held_out_third()).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    left = quality.drop_low_quality(docs, labels)
    assert left.columns == docs.columns


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = private_data.digits_of
    out += [(m.start(), m.end(), 2) for m in private_data.CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and private_data.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in private_data.PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for alphabet in ("ab1.2@-+ %9(", "0123456789 -.", "+1 ()-23"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(1, 45)))
            assert private_data.base_spans(t) == brute_spans(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "@" * 50_000, "a@" * 50_000):
        private_data.base_spans(t)
    many = " ".join(f"call 319-555-{k % 10000:04d} or a{k}@mail.com, ip 1.2.3.4" for k in range(30_000))
    spans = private_data.candidates(many)
    assert len(spans) == 90_000
    model = private_data.fit_spans([(k, v, 1) for k, v in {(s[2], s[4]) for s in spans}], [(s[2], s[4], s[5], 1) for s in spans[:300]])
    assert len(private_data.accepted(spans, model)) > 50_000


def test_candidates_leave_base_spans_alone_and_accepted_ones_don_t_overlap():
    r = random.Random(6)
    for _ in range(400):
        t = "".join(r.choice(["a@b.c", " ", "1.2.3.4", "+1 319 555 1234", "319-555-1234", " at ", "x", "4111 1111 1111 1111", ".", "de"]) for _ in range(12))
        spans = private_data.candidates(t)
        base = [s for s in spans if s[3]]
        assert [s[:3] for s in base] == brute_spans(t)
        others = [s for s in spans if not s[3]]
        assert not any(a[0] < b[1] and b[0] < a[1] for a in others for b in base)
        model = private_data.SpanClassifier({k: np.append(np.zeros(private_data.INPUTS - 1), 9.0) for k in range(4)})
        kept = [s for s in private_data.accepted(spans, model) if not s[3]]
        assert not any(a[0] < b[1] and b[0] < a[1] for k, a in enumerate(kept) for b in kept[:k])
        assert all(any(a[0] < b[1] and b[0] < a[1] for b in kept) for a in others)


def test_span_classifier_learns_from_the_context():
    """Two contexts with equal votes but for one labeler: features carry the difference to spans on which it abstains."""
    code = lambda *votes: sum(v * 3 ** (4 - k) for k, v in enumerate(votes))
    text = {True: "client 4485-2751-7423-1235 on file", False: "parcel 4485-2751-7423-1235 on file"}
    feats = {k: private_data.features_of(t, 7, 26) for k, t in text.items()}
    assert feats[True] != feats[False]
    good, bad, open_ = code(2, 2, 2, 2, 2), code(0, 1, 1, 1, 2), code(0, 0, 0, 0, 2)
    votes = [(2, good, 500), (2, bad, 500)]
    model = private_data.fit_spans(votes, [(2, good, feats[True], 500), (2, bad, feats[False], 500)])
    assert model.score(2, open_, feats[True]) > 0.55 > 0.45 > model.score(2, open_, feats[False])
    assert model.score(0, good, feats[True]) == 0.0  # nothing was learned of this kind


def test_pattern_bound_samples_by_hash(spark):
    found = spark.createDataFrame([(k, [(0, 5, k % 4, True, k % 243, k)]) for k in range(3000)], f"doc_id long, found {private_data.FOUND}")
    seen = []
    plain = private_data.fit_spans
    try:
        private_data.fit_spans = lambda votes, patterns: seen.append((votes, patterns)) or plain(votes, patterns)
        private_data.fit_classifier(found, max_patterns=100)
    finally:
        private_data.fit_spans = plain
    votes, patterns = seen[0]
    assert sum(n for *_, n in votes) == 3000 and 50 < len(patterns) <= 100


def test_reliabilities_find_the_good_labelers():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.4
    votes = np.stack([np.where(r.random(4000) < q, truth, ~truth) + 1 for q in (0.95, 0.9, 0.55)], axis=1)
    table, prior, post = private_data.reliabilities(votes, np.ones(4000))
    assert abs(prior - 0.4) < 0.05
    assert table[0, 1, 2] > 0.9 > table[2, 1, 2]
    assert ((post > 0.5) == truth).mean() > 0.9


def test_private_data_finds_more_and_keeps_the_base(spark, docs, no_docs):
    near = [f"call me by phone at (319) 555-{n:04d} today, or write to user{n}@mail.com" for n in range(40)]
    base = [f"phone +1 (319) 555-{n:04d} mail user{n}@mail.org ip address 10.0.0.{n}" for n in range(200)]
    rows = [(k, t) for k, t in enumerate(near + base + ["nothing at all", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private_data.find_private(df).collect()}
    assert all(any(s.kind == "phone" and not s.base for s in got[k]) for k in range(40))
    for k, t in rows:
        assert [(s.start, s.end, private_data.KINDS.index(s.kind)) for s in got[k] if s.base] == brute_spans(t or "")
    clean = {r.doc_id: r.text for r in private_data.redact(df).collect()}
    assert clean[0] == "call me by phone at [PHONE] today, or write to [EMAIL]"
    assert clean[len(rows) - 1] is None and clean[len(rows) - 2] == "nothing at all"
    assert private_data.find_private(no_docs).count() == 0
    assert private_data.redact(docs).columns == docs.columns


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = graded(spark)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    copies = docs.where("doc_id in (3, 7)").withColumn("doc_id", F.col("doc_id") + 1000)
    near = docs.where("doc_id = 4").withColumns({"doc_id": F.lit(2000).cast("long"), "text": F.concat("text", F.lit(" more mail a.b@mail.com"))})
    docs.unionByName(copies).unionByName(near).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    good = {k for k in range(400) if k % 5}
    assert left <= good | {2000}
    assert left >= good - {2000} and not left & {1003, 1007}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, f"file://{tmp_path}").columns == table.columns, name
