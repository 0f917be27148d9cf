"""Every opN_ query on awkward tables, against recomputations that share no code with the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from ledgerweave.llm import catalog, language, private_data, quality
from pyspark.sql import functions as F

from .conftest import awkward_rows, words
from .test_models import brute_spans
from .test_tokens import ODD, check_packing, library
from .test_vectors import check_whitened

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mark long, once boolean, component long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents of unique ids (as the contracts have them), labels and embeddings, as Parquet."""
    r = random.Random(12)
    texts = [row[1] for row in awkward_rows()] + ODD
    texts += [f"mail bob{k}@mail.com or call +1 (319) 555-{k:04d}, ip 10.0.{k}.1, card 4111 1111 1111 1111" for k in range(20)]
    texts += [f"write to bob{k} at mail dot com or (319) 555-{k:04d} by phone" for k in range(20)]
    spoken = {"aa": "the and of to in that", "bb": "der die und das nicht ein"}
    rows = [(t, None) for t in texts]
    rows += [(" ".join(r.choice(spoken[lang].split()) for _ in range(30)), lang) for k in range(60) for lang in spoken]
    base = words(200, 77)
    rows += [(base, "aa"), (base + " one more", "aa"), (words(400, 78) + " " + base, None), (base.replace(" ", "\n"), None)]
    path = tmp_path_factory.mktemp("tables")
    docs = [(k, t, lang, "s", len(t or ""), k, True, 7) for k, (t, lang) in enumerate(rows)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int("#" not in (t or "#")), 0) for k, (t, _) in enumerate(rows)] + [(3, None, None), (None, 1, 0), (5, 0, 0), (5, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    g = np.random.default_rng(5)
    centers = g.standard_normal((6, 12))
    vectors = [(k, [float(x) for x in centers[k % 6] + g.standard_normal(12) * g.choice([0.02, 0.1, 0.2])], k % 2 if k % 13 else None) for k in range(120)]
    vectors += [(200, None, 1), (201, [0.0] * 12, 1), (202, [1.0, None] * 6, 1), (203, [float("nan")] * 12, 1), (204, vectors[4][1], 0), (205, [], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return f"file://{path}", [(k, t, lang) for k, (t, lang) in enumerate(rows)]


def run(spark, folder, name):
    df = catalog.queries()[name](spark, folder[0])
    return df.columns, df.collect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_with_sql(spark, folder, name):
    columns, rows = run(spark, folder, name)
    with duckdb.connect() as db:
        for table in ("documents", "labels", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder[0][7:]}/{table}.parquet/*.parquet')")
        found = db.execute(catalog.oracle_sql()[name])
        order = [[c[0] for c in found.description].index(c) for c in columns]
        want = [tuple(row[k] for k in order) for row in found.fetchall()]
    assert Counter(tuple(r) for r in rows) == Counter(want)


def test_packed_pieces(spark, folder):
    _, rows = run(spark, folder, "op1_best_fit_packing")
    want = []
    for k, t, _ in folder[1]:
        ids = [*library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids, 0]
        for piece, lo in enumerate(range(0, len(ids), 2048)):
            part = ids[lo : lo + 2048]
            want.append((k, piece, lo, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    n, total = check_packing(rows, 2048), sum(w[3] for w in want)
    assert n <= -(-total // 2048) + 2


def held_out(k: int, parts: int, which: int) -> bool:
    return zlib.crc32(str(k).encode()) % parts == which


def test_languages(spark, folder):
    """Trigram vectors are multiplied out one by one here, and prototypes are sums over whole documents."""
    _, rows = run(spark, folder, "op2_language_id")
    letters = np.random.default_rng(language.SEED).integers(0, 2, (language.CODES, language.DIM)) * 2 - 1

    def profile(text):
        code = [0]
        for c in (text or "").lower():
            at = ord(c) - 96 if "a" <= c <= "z" else (ord(c) * 2654435761 % 2**64 >> 16) % (language.CODES - 27) + 27 if c.isalpha() else 0
            if at or code[-1]:
                code.append(at)
        code += [0] if code[-1] else []
        total = np.zeros(language.DIM)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total, max(1, len(code) - 2)

    prototypes = defaultdict(lambda: np.zeros(language.DIM))
    for k, t, lang in folder[1]:
        if lang and not held_out(k, 4, 2):
            vector, n = profile(t)
            prototypes[lang] += vector / n
    for r in rows:
        text = folder[1][r.doc_id][1]
        assert r.held_out == held_out(r.doc_id, 4, 2)
        vector, _ = profile(text)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {lang: vector @ p / np.linalg.norm(vector) / np.linalg.norm(p) for lang, p in sorted(prototypes.items()) if np.linalg.norm(vector)}
        best = max(cosine.values(), default=0.0)
        assert abs(r.score - max(0.0, best)) < 1e-3, text
        assert not cosine or cosine[r.lang_pred] > best - 2e-3
    assert len(rows) == len(folder[1])
    assert all(r.lang_pred == folder[1][r.doc_id][2] for r in rows if r.held_out and folder[1][r.doc_id][2] and len(folder[1][r.doc_id][1]) < 300)


def test_quality_scores(spark, folder):
    """The model is fitted on rows joined here, and each score added up from its tables one entry at a time."""
    _, rows = run(spark, folder, "op3_quality")
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet").collect()
    marks = defaultdict(list)
    for r in labels:
        if r.doc_id is not None and r.quality in (0, 1):
            marks[r.doc_id].append(r.quality)
    known = {k: float(np.mean(v) > 0.5) for k, v in marks.items() if np.mean(v) != 0.5 and not held_out(k, 3, 1)}
    order = {r.doc_id: r.h for r in spark.range(len(folder[1])).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    ids = sorted(known, key=order.get)
    model = quality.AdditiveModel(np.array([quality.features(folder[1][k][1]) for k in ids]), np.array([known[k] for k in ids]))
    for r in rows:
        x = quality.features(folder[1][r.doc_id][1])
        at = [sum(v >= c for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
        coarse = [a * quality.PAIR_BINS // len(table) for a, table in zip(at, model.tables, strict=True)]
        logit = model.intercept + sum(table[a] for a, table in zip(at, model.tables, strict=True))
        logit += sum(table[coarse[a], coarse[b]] for (a, b), table in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9
        assert r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id, 3, 1)
    assert len(rows) == len(folder[1])


def test_private_data_digests(spark, folder):
    _, rows = run(spark, folder, "op6_private_data")
    assert len(rows) == len(folder[1])
    more = 0
    for r in rows:
        base = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, b, k in brute_spans(folder[1][r.doc_id][1] or "")]
        kinds = Counter(s.split(":")[0] for s in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert [s for s in found if s in base] == base
        place = lambda s: (int(s.split(":")[1]), private_data.KINDS.index(s.split(":")[0]))
        assert found == sorted(found, key=place)
        more += len(found) - len(base)
    assert more >= 20


def test_token_counts_query(spark, folder):
    _, rows = run(spark, folder, "op7_token_counts")
    want = []
    for k, t, _ in folder[1]:
        n = len(library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 2048))
    assert Counter(tuple(r) for r in rows) == Counter(want)


def test_piece_digests(spark, folder):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, rows = run(spark, folder, "op9_sentence_pieces")
    want = []
    for k, t, _ in folder[1]:
        ids = plain.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids))))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == Counter(want)


def test_whitened_rows(spark, folder):
    _, rows = run(spark, folder, "op11_embedding_whitening")
    stored = spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()
    check_whitened(rows, [(r.vec_id, r.embedding, r.label) for r in stored])
