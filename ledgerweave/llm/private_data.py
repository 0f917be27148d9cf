"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated by expectation
maximisation, and a span classifier is trained on the resulting soft labels, from features of the span and its context.

Only counts of vote patterns and a bounded sample of feature patterns reach the driver, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, with_package, written

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a span that the context labeler reads.
WINDOW = 40
THRESHOLD = 0.9
EM_STEPS = 100
LOGIT_STEPS = 60
RIDGE = 0.5
#: Distinct patterns (kind, votes, features) that the classifier is fitted on at most, those of the smallest hashes.
MAX_PATTERNS = 20_000

# Base patterns, fixed by the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser patterns for further candidates; each starts at a word's edge and has bounded parts.
MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,63} ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([ ._/-]{0,2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[1-9][0-9]?[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
HINT = re.compile(r"[0-9@]|[\[(]at[\])]| at ", re.IGNORECASE)

# Gazetteers: fixed values.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk it nl eu ch at be pt pl us ca au jp cn in br ru example".split())
CARD_PREFIXES = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 65 35".split())
FOR = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach|reply|address|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bips?\b|address|host|server|login|logged|client|gateway|ping|adresse|dirección", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|pay|carte|karte|tarjeta|expir|cvv", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel[.:]|mobile|cell|fax|dial|whatsapp|sms|téléphone|telefon|teléfono", re.I),
}
AGAINST = re.compile(r"version|release|\bv$|build|isbn|issn|order|invoice|serial|model|page|section|figure|total|\bsku\b|tracking", re.I)
LABELERS = ("form", "checksum", "gazetteer", "context", "edges")
ABSTAIN, NO, YES = 0, 1, 2
# How a span is usually written, and forms that are rather something else.
FORM = {
    "email": (re.compile(r"[^\s@()\[\]]+@[^\s@()\[\]]+"), re.compile(r".* at .* dot .*")),
    "ip": (re.compile(r"[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){7}"), re.compile(r"[01](\.[0-9]){3}")),
    "card": (re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}"), re.compile(r"[0-9]{4}[._/].*")),
    "phone": (re.compile(r"(\+|00|\().*"), re.compile(r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}")),
}
#: Sizes of the features' fields: length, share of digits, separators, the characters before and after, hashes of the words before and after.
FIELDS = (6, 4, 5, 5, 5, 64, 32)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, failing matches dropped.

    An e-mail is found from its @: the pattern takes all of the local characters before it that no earlier match has.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            out.append((start, hit.end(), 0))
            free = hit.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for hit in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in hit[0].split(".")):
            out.append((hit.start(), hit.end(), 1))
    for hit in CARD.finditer(text):
        number = digits_of(hit[0]) if len(hit[0]) <= 40 else ""
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((hit.start(), hit.end(), 2))
    for hit in PHONE.finditer(text):
        if 10 <= len(digits_of(hit[0])) <= 15:
            out.append((hit.start(), hit.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def edge(char: str) -> int:
    """Class of a character beside a span: none or space, opening or quoting, letter, digit, other."""
    return 0 if not char or char.isspace() else 1 if char in "(<[{:;,.\"'=" else 2 if char.isalpha() else 3 if char.isdigit() else 4


def features_of(text: str, start: int, end: int) -> int:
    """The span's features as one number, in the mixed base of FIELDS."""
    span = text[start:end]
    digits = len(digits_of(span))
    marks = {c for c in span if c in ".- ()/:_"}
    kinds = 0 if not marks else 4 if len(marks) > 1 else 1 if "." in marks else 2 if "-" in marks else 3
    before, after = text[max(0, start - WINDOW) : start].split()[-1:], text[end : end + WINDOW].split()[:1]
    hashed = lambda words, size: 1 + zlib.crc32(words[0].lower().encode()) % (size - 1) if words else 0
    values = (
        min(5, (end - start) // 6), min(3, 4 * digits // max(1, len(span))), kinds, edge(text[start - 1 : start] if start else ""), edge(text[end : end + 1]),
        hashed(before, FIELDS[5]), hashed(after, FIELDS[6]),
    )
    code = 0
    for size, value in zip(FIELDS, values, strict=True):
        code = code * size + value
    return code


def votes_of(text: str, start: int, end: int, kind: int) -> list[int]:
    """One vote of each labeler on a candidate."""
    span, name = text[start:end], KINDS[kind]
    number = digits_of(span)
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    checksum = gazetteer = ABSTAIN
    if name == "email":
        tail = re.split(r"[^A-Za-z]+", span)[-1].lower()
        gazetteer = YES if tail in TOP_DOMAINS else NO
        checksum = YES if "@" in span and ".." not in span else ABSTAIN
    elif name == "ip":
        parts = span.split(".") if "." in span else []
        checksum = YES if not parts or len(parts) == 4 and all(int(p[:4]) <= 255 and (p == "0" or p[0] != "0") for p in parts) else NO
        gazetteer = NO if parts and parts[0] == "0" else ABSTAIN
    elif name == "card":
        checksum = YES if luhn(number) else NO
        gazetteer = YES if number.startswith(CARD_PREFIXES) else NO
    else:
        checksum = YES if 10 <= len(number) <= 15 else NO
        area = number[-10:-7]
        gazetteer = YES if area[:1] not in ("", "0", "1") and number[-7:-6] not in ("0", "1") else NO
    context = YES if FOR[name].search(before) or FOR[name].search(after) else NO if AGAINST.search(before) else ABSTAIN
    joined = start > 0 and (text[start - 1].isalnum() or text[start - 1] in "._-/") or end < len(text) and (text[end].isalnum() or text[end : end + 1] in "_-/")
    usual, other = FORM[name]
    form = YES if usual.fullmatch(span) else NO if other.fullmatch(span) else ABSTAIN
    return [form, checksum, gazetteer, context, NO if joined else YES]


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, end, kind, base, votes as one number to the base 3, features) of the candidates of a text, by start, then kind.

    No further candidate lies where a base span already is.
    """
    if not text or not HINT.search(text):
        return []
    base = base_spans(text)
    starts, ends = merged([s[:2] for s in base])
    found = [(*s, True) for s in base]
    for kind, name in enumerate(KINDS):
        for hit in MORE[name].finditer(text):
            at = bisect_left(starts, hit.end()) - 1  # the last base span that starts before the candidate ends
            if at < 0 or ends[at] <= hit.start():
                found.append((hit.start(), hit.end(), kind, False))
    out = []
    for start, end, kind, own in sorted(found, key=lambda s: (s[0], s[2], s[1])):
        code = 0
        for vote in votes_of(text, start, end, kind):
            code = 3 * code + vote
        out.append((start, end, kind, own, code, features_of(text, start, end)))
    return out


FOUND = "array<struct<start:int,end:int,kind:int,base:boolean,votes:int,features:int>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found: the candidate spans of the whole text, in code points."""
    with_package(docs.sparkSession)
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])

    def run(batches):
        names = [f.name for f in item]
        for batch in slices(batches):
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {FOUND}")


def unpack(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)]


def reliabilities(votes: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, float, np.ndarray]:
    """(P(vote | class) of each labeler, P(true), P(true | votes) of each pattern) by expectation maximisation.

    votes has the values ABSTAIN, NO and YES; it starts from the majority of the votes given.
    """
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)
    table, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(steps):
        weights = np.stack([(1 - post) * counts, post * counts])
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        for j in range(votes.shape[1]):
            for c in range(2):
                table[j, c] = np.bincount(votes[:, j], weights[c], minlength=3) + (0.5, 1.0, 1.0)
                table[j, c, YES if c else NO] += 1.0  # labelers are taken to be better than chance
                table[j, c] /= table[j, c].sum()
        log = np.log(np.array([1 - prior, prior]))[None, :] + sum(np.log(table[j][:, votes[:, j]].T) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return table, float(prior), post


#: Where each field begins among the classifier's inputs: a yes and a no of each labeler, then the features, then a constant.
OFFSETS = [2 * len(LABELERS) + sum(FIELDS[:k]) for k in range(len(FIELDS))]
INPUTS = 2 * len(LABELERS) + sum(FIELDS) + 1


def inputs_of(votes: int, features: int) -> list[int]:
    """The classifier's inputs that are 1."""
    out = [2 * j + (vote == YES) for j, vote in enumerate(unpack(votes)) if vote != ABSTAIN]
    for size, offset in zip(FIELDS[::-1], OFFSETS[::-1], strict=True):
        features, value = divmod(features, size)
        out.append(offset + value)
    return [*out, INPUTS - 1]


class SpanClassifier:
    """Logistic regression of each kind on the votes and the features of a span and its context."""

    def __init__(self, weights: dict[int, np.ndarray]):
        self.weights = weights
        self.known: dict[tuple[int, int, int], float] = {}

    def score(self, kind: int, votes: int, features: int) -> float:
        key = kind, votes, features
        value = self.known.get(key)
        if value is None:
            if len(self.known) > 100_000:
                self.known.clear()
            w = self.weights.get(kind)
            value = self.known[key] = 0.0 if w is None else float(1 / (1 + np.exp(-w[inputs_of(votes, features)].sum())))
        return value


def soft_labels(votes: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """P(true) of each (kind, votes) of the patterns (kind, votes, count), by EM for each kind."""
    soft = {}
    for kind in range(len(KINDS)):
        mine = sorted((c, n) for k, c, n in votes if k == kind)
        if mine:
            post = reliabilities(np.array([unpack(c) for c, _ in mine]), np.array([n for _, n in mine], dtype=float))[2]
            soft |= {(kind, c): float(p) for (c, _), p in zip(mine, post, strict=True)}
    return soft


def fit_spans(votes: list[tuple[int, int, int]], patterns: list[tuple[int, int, int, int]]) -> SpanClassifier:
    """The classifier from counts of (kind, votes) of all candidates and of patterns (kind, votes, features, count)."""
    soft, weights = soft_labels(votes), {}
    for kind in range(len(KINDS)):
        mine = sorted(p for p in patterns if p[0] == kind)
        if not mine:
            continue
        x = np.zeros((len(mine), INPUTS))
        for row, (_, code, features, _) in zip(x, mine, strict=True):
            row[inputs_of(code, features)] = 1.0
        y = np.array([soft[kind, code] for _, code, _, _ in mine])
        each = np.log1p([n for *_, n in mine])  # frequent patterns must not drown rare ones
        w = np.zeros(INPUTS)
        for _ in range(LOGIT_STEPS):  # Newton steps of a ridge-regularised logistic regression
            p = 1 / (1 + np.exp(-(x @ w)))
            grad = x.T @ (each * (y - p)) - RIDGE * w
            hess = (x * (each * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(INPUTS)
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        weights[kind] = w
    return SpanClassifier(weights)


def fit_classifier(found: DataFrame, max_patterns: int = MAX_PATTERNS) -> SpanClassifier:
    """The span classifier, with reliabilities learned from all candidates of found."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    each = written(each.withColumn("h", F.xxhash64("kind", "votes", "features")), "patterns")
    counts = each.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    votes = [(r["kind"], r["votes"], r["n"]) for r in counts.collect()]  # at most kinds x 3 ** labelers rows
    total = each.count()
    if total > max_patterns:  # a bound on the hash that leaves at most about max_patterns rows before the limit
        each = each.where(F.col("h") <= int(-(2**63) + min(1.0, 1.1 * max_patterns / total) * (2**64 - 1)))
    rows = each.orderBy("h", "kind", "votes", "features").limit(max_patterns)
    return fit_spans(votes, [(r["kind"], r["votes"], r["features"], r["n"]) for r in rows.collect()])


def accepted(spans: list[tuple[int, int, int, bool, int, int]], model: SpanClassifier) -> list[tuple[int, int, int, bool]]:
    """Base spans, and the candidates above the threshold that overlap nothing better."""
    keep = [s[:4] for s in spans if s[3]]
    good = sorted((-model.score(s[2], s[4], s[5]), s) for s in spans if not s[3])
    taken: list[tuple[int, int]] = []  # disjoint; candidates don't overlap base spans
    for negative, span in good:
        if -negative < THRESHOLD:
            break
        at = bisect_left(taken, (span[1],)) - 1
        if at < 0 or taken[at][1] <= span[0]:
            insort(taken, (span[0], span[1]))
            keep.append(span[:4])
    return sorted(keep, key=lambda s: (s[0], s[2], s[1]))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) for every row of docs (doc_id, text), by start, then kind.

    Defined cases: null and empty texts have no spans; repeated rows each get theirs; without any candidate in the table
    nothing is learned and nothing added; other columns are ignored.
    """
    found = written(with_candidates(docs), "candidates")
    model = found.sparkSession.sparkContext.broadcast(fit_classifier(found))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                kept = accepted([tuple(s.values()) for s in spans], model.value)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, b, k, own in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the texts replaced by its kind in brackets, and n_chars (where it is a column) counted anew.

    Candidates are found twice, once to learn from and once to replace, so that no text is shuffled.

    Defined cases: a null text stays null and an empty one empty; very long texts are read whole; every row is redacted by
    itself, repeated ones alike; without any candidate in the table all rows stay as they are; an empty table stays empty;
    all other columns, whatever their names, are passed on.
    """
    found = written(with_candidates(docs), "candidates")
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(found))
    discard(found)
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        spans = accepted(candidates(text), model.value)
        if not spans:
            return text
        out, done = [], 0
        for start, end, kind, _ in spans:
            if start >= done:
                out += [text[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in slices(batches):
            texts = [clean(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            if counted is not None:
                sizes = [n if new is None else len(new) for n, new in zip(columns[counted].to_pylist(), texts, strict=True)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda keep: F.array_join(
        F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    counts = []
    for kind in KINDS:
        own = F.filter(base, lambda s: s["kind"] == kind)  # noqa: B023  the column is built at once
        counts.append(F.size(own).cast("long").alias(f"n_{kind}"))
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
