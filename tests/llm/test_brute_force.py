"""Trained operators against loops in plain Python, crowds of near copies, and hand-made trees of urls."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthspark.llm import decontaminate, language_id, near_dedup, pii, quality, spans, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# quality


def _slots(text: str) -> list[int]:
    """A text's token slots by one pass over its tokens."""
    out, last = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text, re.ASCII):
        token = m[0]
        low = "".join(ch.lower() if ch.isascii() else ch for ch in token)
        h = int(next(iter(spans.chunks(pa.array([low])))).hashes(np.array([0]), np.array([len(low.encode())]))[0])
        slot = quality._FIRST + h % (quality.SLOTS - quality._FIRST)
        is_word = bool(re.match(r"[0-9A-Za-z\x80-\U0010ffff]", token))
        if is_word and sum(ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for ch in token) > 1 and not re.search("[a-z]", token):
            slot = quality._CAPITALS
        if is_word:
            if low == last:
                slot = quality._REPEAT
            last = low
        out.append(slot)
    return out


def test_quality_equals_loops(spark, docs, labels):
    some = docs.filter("doc_id < 40 and length(text) < 4000")
    extra = spark.createDataFrame([(900, "The the THE the. NATO NATO, a1 a1 !! éé\n\nÉé"), (901, ""), (902, None), (903, "... --- ...")], "doc_id long, text string")
    both = some.select("doc_id", "text").unionByName(extra)
    rows = both.collect()
    sums = np.zeros((quality.SLOTS, quality.SIZE))
    slots = {r["doc_id"]: _slots(r["text"] or "") for r in rows}
    for s in slots.values():
        for i, x in enumerate(s):
            for j in range(max(0, i - quality.REACH), min(len(s), i + quality.REACH + 1)):
                if j != i:
                    for t in range(quality.NONZERO):
                        sums[x, quality._PLACE[s[j], t]] += quality._SIGN[s[j], t]
    got = quality.context_sums(both)
    assert np.allclose(got, sums)
    vectors = quality.unit_rows(got)
    net = quality.train(docs, labels, vectors)
    a, b, c, d = net.layers
    for r in quality.score(both, vectors, net).collect():
        s = slots[r["doc_id"]]
        x = [0.0] * (quality.SIZE + 4)
        for slot in s:
            n = math.sqrt(sum(v * v for v in sums[slot]))
            for k in range(quality.SIZE):
                x[k] += sums[slot][k] / max(n, 1e-9) / len(s)
        x[quality.SIZE] = math.sqrt(sum(v * v for v in x[: quality.SIZE]))
        x[quality.SIZE + 1] = math.log1p(len(s))
        x[quality.SIZE + 2] = s.count(quality._REPEAT) / max(len(s), 1)
        x[quality.SIZE + 3] = s.count(quality._CAPITALS) / max(len(s), 1)
        z = [(v - m) / e for v, m, e in zip(x, net.mean, net.scale)]
        hidden = [math.tanh(sum(z[i] * a[i][h] for i in range(len(z))) + b[h]) for h in range(len(b))]
        logit = sum(u * v for u, v in zip(hidden, c)) + float(d)
        assert abs(r["score"] - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-4
        assert r["predicted"] == (r["score"] >= 0.3)


# language


def test_language_score_equals_loops(docs):
    model = language_id.train(docs.filter(~language_id.held_out()), sample=30, rounds=15)
    texts = [r["text"] for r in docs.filter("length(text) between 1 and 3000").limit(12).collect()] + ["one", "und der und", "a " * 200]
    lang, score = language_id.verdicts(pa.array(texts), model)
    move = model.transitions
    for text, found, value in zip(texts, lang, score):
        f = language_id.Features(next(iter(spans.chunks(pa.array([text])))))
        e = f.scores(model.weights, model.lexicon, model.lexicon_weights).astype(float)
        if not len(e):
            assert found == "und"
            continue
        k = e.shape[1]
        alpha, beta = [list(e[0])], [[0.0] * k]
        add = lambda v: max(v) + math.log(sum(math.exp(x - max(v)) for x in v))
        for i in range(1, len(e)):
            alpha.append([add([alpha[-1][x] + move[x][y] for x in range(k)]) + e[i][y] for y in range(k)])
        for i in range(len(e) - 2, -1, -1):
            beta.insert(0, [add([move[x][y] + e[i + 1][y] + beta[0][y] for y in range(k)]) for x in range(k)])
        mean = [0.0] * k
        for p, q in zip(alpha, beta):
            total = add([x + y for x, y in zip(p, q)])
            mean = [m + math.exp(x + y - total) / len(e) for m, x, y in zip(mean, p, q)]
        best = max(range(k), key=mean.__getitem__)
        assert found == model.labels[best] and abs(value - mean[best]) < 1e-5


# near duplicates


def test_crowd_of_copies_of_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(90)]

    def edited(w, n):
        out = list(w)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    variants = [edited(base, 6) for _ in range(4)]
    rows = [(i, " ".join(edited(base if i % 3 else variants[i % 4], rng.randrange(0, 6)))) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)] + [(300, rows[0][1]), (301, rows[5][1].upper())]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect())
    assert got == sorted(near_dedup.brute_force(rows, 3, 85))


# url filter


def test_templates_judge_their_unlabelled_urls(spark):
    urls = [f"http://a.net/{b}/{i}{e}" for b in ("es", "fr", "en") for i in range(40) for e in ("", ".html")]
    urls += [f"http://b.org/{b}/{i}" for b in ("x", "y") for i in range(40)]  # nothing there has a label
    urls += [f"http://c.net/es/{i}" for i in range(40)] + [f"http://c.net/shop/item/{i}/buy" for i in range(40)]  # another shape below
    urls += [urls[80]] * 3 + ["http://a.net/en/" + "9" * 5000, "no scheme", None]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, label string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(rows)
    verdicts = {}
    for i, u, *_ in rows:
        key = (got[i]["host"], got[i]["path"].split("/")[1] if got[i]["path"] else "")
        verdicts.setdefault(key, set()).add(got[i]["verdict"])
    assert verdicts["a.net", "es"] == verdicts["a.net", "fr"] == verdicts["a.net", "en"] == verdicts["c.net", "es"] == {"block"}
    assert verdicts["b.org", "x"] == verdicts["b.org", "y"] == verdicts["c.net", "shop"] == verdicts["", ""] == {"allow"}
    assert all(got[i]["rule"] is None and got[i]["template"] for i, u, *_ in rows if u and "a.net/en" in u)
    allowed = spark.createDataFrame([(i, f"http://a.com/{b}/{i}") for i in range(60) for b in ("en", "fr")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(allowed).collect()} == {"allow"}


# odd input


def test_nulls_and_names(spark, docs, labels):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.org now")], "doc_id long, text string").withColumn("__spans", F.lit("mine"))
    masked = {r["doc_id"]: (r["text"], r["__spans"]) for r in pii.mask(odd).collect()}
    assert masked == {1: (None, "mine"), 2: ("", "mine"), 3: ("mail <EMAIL> now", "mine")}
    model = language_id.train(docs.filter(~language_id.held_out()), sample=10, rounds=3)
    assert {r["doc_id"] for r in language_id.label_words(odd, model).collect()} == {3}
    toxic = toxicity.train(docs, labels)
    assert toxicity.passages(odd.filter("text is null or text = ''"), toxic).count() == 0
    nothing = spark.createDataFrame([], "item_id string, text string")
    left = decontaminate.decontaminate(docs, nothing)
    assert left.count() == docs.count() and left.columns == docs.columns


def test_secrets_of_many_kinds(spark):
    rng = random.Random(1)
    text = "".join
    key = lambda n: text(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"plain words {i} and internationalisation_of_everything_in_the_world here") for i in range(30)]
    rows += [(100 + i, f"token = '{text(rng.choice('0123456789abcdef') for _ in range(40))}' end") for i in range(12)]
    rows += [(200 + i, f"token ghp_{key(36)} end") for i in range(6)] + [(300 + i, f"key AKIA{key(16).upper()} end") for i in range(6)] + [(400 + i, f"key=sk-proj-{key(44)}") for i in range(6)]
    got = {r["doc_id"]: r["n_secret"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i] == (1 if i >= 100 else 0) for i, _ in rows)
