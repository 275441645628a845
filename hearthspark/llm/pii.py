"""Personal data by weak supervision: labelers vote, EM rates the labelers, and a classifier trained on that decides.

Everything on the executors is DataFrame expressions. One pass finds candidate spans: the matches of the four base
patterns, and shapes beyond them (long secrets and keys with known prefixes, local phone numbers, grouped identity numbers). Six labelers (strict
form, gazetteer, words before, digit variety, marks around, length) vote -1, 0 or 1 on each. Votes are discrete, so
the corpus is summed up in at most 3**6 rows a kind; expectation-maximisation over those rows estimates how reliable
each labeler is. A logistic span classifier is then fitted to those probabilities on the votes and on features of its own (``FEATURES``: variety, digits, capitals and
changes of character class of the value, and what stands before it, each in a few steps), and it decides. Base spans
always stay; candidates of other kinds are added where the classifier says so and no base span meets them.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows give
repeated results; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "national_id", "local_phone")
LABELERS = ("strict", "gazetteer", "context", "variety", "marks", "length")

#: What the classifier sees of a span, each as a step from 0 to 3: distinct characters, share of digits, share of
#: capitals, changes between letters and digits, letters beyond hexadecimal in a row, and marks or words just before.
FEATURES = ("distinct", "digits", "capitals", "changes", "wordy", "before")
STEPS = 4

#: How keys of known services begin.
_PREFIX = r"(?:gh[pousr]_|AKIA|sk-|xox[abp]-|eyJ)"
#: Same matches as the published base patterns, written so that Java's matcher neither recurses nor rescans a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![A-Za-z0-9_/+-])(?:[A-Za-z0-9_/+-]{{24,}}+|{_PREFIX}[A-Za-z0-9_/+-]++)",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Texts without this have no match.
_NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(rf"[A-Za-z0-9_/+-]{{24}}|{_PREFIX}[A-Za-z0-9_/+-]"),
    "national_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}"),
}
#: Words that speak for or against each kind when they stand just before a span.
_FOR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|mailto)\b", "ip": r"(?i)\b(ip|host|server|address|addr)\b", "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit)\b",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell)\b", "secret": r"(?i)\b(token|secret|api[_ -]?key|key|password|passwd|bearer|credential)\b",
    "national_id": r"(?i)\b(ssn|social security|national id|tax id)\b", "local_phone": r"(?i)\b(tel|phone|call|fax|mobile|cell)\b",
}
_AGAINST = r"(?i)\b(version|release|isbn|issn|order|invoice|page|section|figure|commit|sha1|sha256|md5|revision|https?)\b"
#: Endings, prefixes and leading digits that known values have.
_KNOWN = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|co|uk|de|fr|es|info)$", "ip": r"^(?!0+\.|127\.|255\.)", "card": r"^(3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", "secret": rf"^({_PREFIX}|[0-9a-fA-F]{{32,}}$)",
    "national_id": r"^(?!000|666|9)", "local_phone": r"^\(?[2-9]",
}


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return (v.rlike("[0-9]") & v.rlike("[A-Za-z]")) | (v.rlike(f"^{_PREFIX}") & (F.length(v) >= 20))
    return F.lit(True)


def _votes(kind: str, v: Column, before: Column, after: Column) -> list[Column]:
    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, 1).otherwise(F.when(no, -1).otherwise(0) if no is not None else F.lit(-1))

    variety = F.size(F.array_distinct(F.split(_digits(v), ""))) if kind != "email" else F.length(F.regexp_replace(v, r"@.*", ""))
    longest = {"email": 80, "ip": 15, "card": 23, "phone": 22, "secret": 128, "national_id": 11, "local_phone": 14}[kind]
    strict, length = vote(_valid(kind, v)), F.length(v) <= longest
    if kind == "secret":  # letters of one case beyond hexadecimal in a row look like words; this is one vote, and not against known prefixes
        wordy = v.rlike(r"[g-z]{5}|[G-Z]{5}") & ~v.rlike(f"^{_PREFIX}")
        strict, length = vote(_valid(kind, v) & ~wordy), F.length(v).between(16, longest)
    return [
        strict,
        vote(v.rlike(_KNOWN[kind])),
        vote(before.rlike(_FOR[kind]), before.rlike(_AGAINST)),
        vote(variety > 3, variety <= 2),
        vote(before.rlike(r"[=:\x22'(<]\x20?$"), before.rlike(r"[A-Za-z0-9_/.-]$") | after.rlike(r"^[A-Za-z0-9_/@-]")),
        vote(length),
    ]


def _features(v: Column, before: Column) -> Column:
    n = F.greatest(F.char_length(v), F.lit(1))

    def step(x: Column, a: float, b: float, c: float) -> Column:
        return F.when(x < a, 0).when(x < b, 1).when(x < c, 2).otherwise(3)

    changes = F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Za-z]+", "a"), "[0-9]+", "0"), "[^a0]", ""))
    wordy = F.char_length(F.regexp_extract(v, "[g-z]{3,}|[G-Z]{3,}", 0))
    near = F.when(before.rlike(r"[=:\x22'(<]\x20?$"), 3).when(before.rlike(r"(?i)[a-z]\x20$"), 2).when(before.rlike(r"\s$"), 1).otherwise(0)
    return F.array(
        step(F.size(F.array_distinct(F.split(F.lower(v), ""))), 5, 9, 14),
        step(F.char_length(F.regexp_replace(v, "[^0-9]", "")) / n, 0.05, 0.3, 0.7),
        step(F.char_length(F.regexp_replace(v, "[^A-Z]", "")) / n, 0.01, 0.2, 0.6),
        step(changes, 2, 5, 10),
        step(wordy, 1, 5, 8),
        near,
    )


def candidates(text: Column, kind: str) -> Column:
    """array<struct<kind, start, stop, valid, votes, features>> of one kind's pattern in a non-null text."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(state: Column, i: Column) -> Column:
        before, value, after = F.get(state.getField("between"), i), F.get(state.getField("found"), i), F.get(state.getField("between"), i + 1)
        start = state.getField("at") + F.char_length(before)
        stop = start + F.char_length(value)
        near = F.right(before, F.lit(40))
        one = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), _valid(kind, value).alias("valid"), F.array(*_votes(kind, value, near, F.left(after, F.lit(2)))).alias("votes"), _features(value, near).alias("features"))
        return F.struct(stop.alias("at"), state.getField("between").alias("between"), state.getField("found").alias("found"), F.concat(state.getField("out"), F.array(one)).alias("out"))

    empty = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,valid:boolean,votes:array<int>,features:array<int>>>")
    start = F.struct(F.lit(0).alias("at"), between.alias("between"), found.alias("found"), empty.alias("out"))
    many = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s.getField("out"))
    return F.when(_NEEDS[kind](text) & text.rlike(pattern), many).otherwise(empty)


def all_candidates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the candidate spans of every kind, in kind order, then by start."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select("doc_id", F.concat(*(candidates(F.col("text"), k) for k in BASE + EXTRA)).alias("found"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (kind, votes, count): P(real) of each pattern, and P(vote | real or not) of each labeler.

    Labelers start as a little better than chance and are smoothed towards that, which fixes which class is which.
    """
    n = np.array([x[2] for x in patterns], float)
    votes = np.array([x[1] for x in patterns]).reshape(len(patterns), -1) + 1
    kinds = np.array([(BASE + EXTRA).index(x[0]) for x in patterns])
    table = np.array([[0.4, 0.4, 0.2], [0.2, 0.4, 0.4]])  # of votes -1, 0, 1: not real, real
    p_vote = np.repeat(table[:, None, :], votes.shape[1], 1)
    prior = np.full(len(BASE + EXTRA), 0.5)
    q = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        like = np.stack([np.log(p_vote[y][np.arange(votes.shape[1]), votes]).sum(1) for y in (0, 1)], 1)
        like += np.log(np.stack([1 - prior[kinds], prior[kinds]], 1))
        q = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            for k in range(votes.shape[1]):
                c = np.bincount(votes[:, k], w, 3) + 20 * table[y]
                p_vote[y, k] = c / c.sum()
        for k in range(len(prior)):
            prior[k] = (n[kinds == k] @ q[kinds == k] + 2) / (n[kinds == k].sum() + 4)
    return q, p_vote


def fit_classifier(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> dict[tuple, float]:
    """Logistic weights of ("kind", kind), (labeler, vote) and (feature, kind, step), fitted to EM's probabilities by damped Newton steps.

    ``patterns``: kind, votes, features and how often they come together.
    """
    names = [("kind", k) for k in BASE + EXTRA] + list(itertools.product(LABELERS, (-1, 0, 1))) + [(f, k, u) for f in FEATURES for k in BASE + EXTRA for u in range(STEPS)]
    if not patterns:
        return dict.fromkeys(names, 0.0)
    votes: dict[tuple, int] = {}
    for kind, vote, _, count in patterns:
        votes[kind, vote] = votes.get((kind, vote), 0) + count
    q = dict(zip(votes, reliabilities([(*k, c) for k, c in votes.items()])[0]))
    truth = np.array([q[kind, vote] for kind, vote, _, _ in patterns])
    n = np.log1p(np.array([c for *_, c in patterns], float))
    place = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for row, (kind, vote, features, _) in enumerate(patterns):
        x[row, place["kind", kind]] = 1
        x[row, [place[labeler, u] for labeler, u in zip(LABELERS, vote)]] = 1
        x[row, [place[f, kind, u] for f, u in zip(FEATURES, features)]] = 1
    w = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - truth)) + 0.1 * w
        curve = (x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return dict(zip(names, w.tolist()))


def _patterns(found: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """How often each kind, votes and features come together, summed in Spark: at most 3**6 times 4**6 rows a kind, whatever the corpus."""
    spans = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.features").count()
    return sorted((r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in spans.collect())


def _accepts(weights: dict[tuple, float], span: Column) -> Column:
    """The classifier's decision: one lookup by kind, and one for each vote and feature."""
    kinds = BASE + EXTRA
    at = F.array_position(F.array(*map(F.lit, kinds)), span.getField("kind")).cast("int") - 1
    score = F.get(F.array(*(F.lit(weights["kind", k]) for k in kinds)), at)
    for i, labeler in enumerate(LABELERS):
        score = score + F.get(F.array(*(F.lit(weights[labeler, u]) for u in (-1, 0, 1))), F.get(span.getField("votes"), F.lit(i)) + 1)
    for i, f in enumerate(FEATURES):
        table = F.array(*(F.lit(weights[f, k, u]) for k in kinds for u in range(STEPS)))
        score = score + F.get(table, at * STEPS + F.get(span.getField("features"), F.lit(i)))
    return F.coalesce(score > 0, F.lit(False))


def _base(found: Column) -> Column:
    """Matches of the base patterns, which always stay."""
    return F.filter(found, lambda s: s.getField("kind").isin(*BASE) & s.getField("valid"))


def _more(found: Column, base: Column, weights: dict[tuple, float]) -> Column:
    """Spans of further kinds that the classifier accepts and that no base span meets."""
    meets = lambda s: F.exists(base, lambda b: (b.getField("start") < s.getField("stop")) & (s.getField("start") < b.getField("stop")))
    return F.filter(found, lambda s: s.getField("kind").isin(*EXTRA) & s.getField("valid") & _accepts(weights, s) & ~meets(s))


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, stop, base), kinds in order, then by start. Texts are read once."""
    found = stage(all_candidates(documents, id_col=id_col, text_col=text_col), "pii")
    weights = fit_classifier(_patterns(found))
    found = found.withColumn("base", _base(F.col("found")))
    more = _more(F.col("found"), F.col("base"), weights)

    def plain(x: Column, is_base: bool) -> Column:
        return F.transform(x, lambda s: F.struct(s.getField("kind").alias("kind"), s.getField("start").alias("start"), s.getField("stop").alias("stop"), F.lit(is_base).alias("base")))

    return found.withColumn("more", more).select("doc_id", F.concat(plain(F.col("base"), True), plain(F.col("more"), False)).alias("spans"))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("stop").cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and after them the number of spans of each further kind."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: (s.getField("base") == F.lit(kind in BASE)) & (s.getField("kind") == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_named(F.filter("spans", lambda s: s.getField("base"))).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), *map(count, EXTRA))


def mask(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span that ``find`` gives replaced by its kind in angle brackets; all columns and rows are kept.

    Where base spans of two kinds overlap, the earlier one's kind stands for both.

    The classifier is fitted in a first pass; the second finds the spans of each text where it lies, without a join.
    """
    weights = fit_classifier(_patterns(all_candidates(documents, id_col=id_col, text_col=text_col)))
    text = F.col(text_col)
    found = F.concat(*(candidates(F.coalesce(text, F.lit("")), k) for k in BASE + EXTRA))
    held = max(documents.columns, key=len) + "_spans"  # a name that no column has
    base = f"{held}_base"
    kept = F.concat(F.col(base), _more(F.col(held), F.col(base), weights))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s.getField("start").alias("start"), s.getField("stop").alias("stop"), s.getField("kind").alias("kind"))))

    def cut(state: Column, s: Column) -> Column:
        fresh = s.getField("start") >= state.getField("at")
        gap = F.substring(text, state.getField("at").cast("int") + 1, (s.getField("start") - state.getField("at")).cast("int"))
        out = F.when(fresh, F.concat(state.getField("out"), gap, F.lit("<"), F.upper(s.getField("kind")), F.lit(">"))).otherwise(state.getField("out"))
        return F.struct(F.greatest(s.getField("stop"), state.getField("at")).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(ordered, start, cut, lambda s: F.concat(s.getField("out"), F.substring(text, s.getField("at").cast("int") + 1, F.char_length(text))))
    out = documents.withColumn(held, found).withColumn(base, _base(F.col(held)))
    return out.withColumn(text_col, F.when(F.size(held) > 0, masked).otherwise(text)).drop(held, base)


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by Python's ``re`` and the published patterns, for tests."""
    import re

    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out
