"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthspark.llm import decontaminate, language_id, license_scan, near_dedup, packing, pii, quality, quality_rules, queries, spans, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, kept string, key string"
LONG = "alpha beta gamma delta " * 8000
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, "9" * 50_000), (9, "a." * 20_000 + "@x.yz"),
    (10, "é ñ ß 漢字 a@b.co 1.2.3.4"), (11, "same words here again and again"), (11, "same words here again and again"), (None, "no id at all"), (12, "\u0000odd\u0001 marks"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "src" if i and i < 8 else None, 1, "x", 2, "y", "z") for i, t in EDGE]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def words_text(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "tor", "ven", "sul", "pra", "dex"]) + rng.choice(["ra", "sen", "tik", "mol"]) for _ in range(n))


# pii


def test_pii_base_spans(spark, edge):
    more = ["a@b.c.d@e.f a@b.c_d@e.f x@y", "256.1.1.1 0001.2.3.4 1.2.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112", "+1 (555) 123-4567 +12 +1 2 3 4 5 6 7 8 9) .5", "𝔘 a@b.co"]
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    found = pii.find(rows).collect()
    texts = rows.collect()
    assert len(found) == len(texts)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["base"]])
    for r in texts:
        assert pii.brute_force(r["text"]) in by_id[r["doc_id"]]


def test_pii_adds_secrets_and_masks(spark):
    noise = [(i, f"plain words here {i} and more") for i in range(20)]
    rows = noise + [(100 + i, f'token = "{i:02d}9c7fab34d1e05b6f8a92{i:02d}c4d7e1" and mail a{i}@b.org end') for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    spans_by = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert all(spans_by[i] == "" for i, _ in noise)
    assert all("secret:" in spans_by[100 + i] and "email:" in spans_by[100 + i] for i in range(10))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[3] == rows[3][1] and masked[100] == 'token = "<SECRET>" and mail <EMAIL> end'


def test_pii_empty(empty):
    assert pii.find(empty).count() == 0 and pii.mask(empty).count() == 0


# language id


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    offsets, scores, move = np.array([0, 5, 5, 205, 206]), rng.normal(size=(206, 3)), rng.normal(size=(3, 3))
    got, pairs = language_id.forward_backward(scores, offsets, move, pairs=True)
    lse = lambda x, a: np.log(np.exp(x - x.max(a, keepdims=True)).sum(a)) + x.max(a)
    total = np.zeros((3, 3))
    for lo, hi in zip(offsets, offsets[1:]):
        s = scores[lo:hi]
        if not len(s):
            continue
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[0] = s[0]
        for i in range(1, len(s)):
            a[i] = lse(a[i - 1][:, None] + move, 0) + s[i]
        for i in range(len(s) - 2, -1, -1):
            b[i] = lse(move + s[i + 1] + b[i + 1], 1)
        p = np.exp(a + b - (a + b).max(1, keepdims=True))
        assert np.allclose(p / p.sum(1, keepdims=True), got[lo:hi], atol=1e-8)
        for i in range(1, len(s)):
            total += np.exp(a[i - 1][:, None] + move + s[i] + b[i] - lse(a[-1], 0))
    assert np.allclose(total, pairs, atol=1e-6)


@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.train(docs.filter(~language_id.held_out()), sample=60, rounds=30)


def test_language_held_out(docs, language_model):
    got = language_id.predict(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out()).filter("lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_code_switch(spark, docs, language_model):
    texts = {r["lang"]: r["text"] for r in docs.filter("lang in ('en', 'de') and length(text) between 600 and 3000").collect()}
    mixed = " ".join(texts["en"].split()[:60] + texts["de"].split()[:60])
    got = language_id.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), language_model).orderBy("start").collect()
    half = len(got) // 2
    assert np.mean([r["label"] == "en" for r in got[: half - 5]]) > 0.9 and np.mean([r["label"] == "de" for r in got[half + 5 :]]) > 0.9


def test_language_edges(edge, empty, language_model):
    got = language_id.predict(edge, language_model).collect()
    assert len(got) == len(EDGE) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert language_id.predict(empty, language_model).count() == 0
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(edge, nothing).collect()} == {"und"}


# toxicity


def test_segments_are_maximal():
    rng = random.Random(5)
    for _ in range(60):
        x = np.array([rng.choice([-2.0, -1.0, -0.5, 1.0, 1.5, 3.0]) for _ in range(rng.randrange(1, 25))])
        got = toxicity.segments(x, 0, len(x), np.concatenate([[0.0], np.cumsum(x)]), np.flatnonzero(x > 0))
        best = max((x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
        if best > 0:
            assert np.isclose(max(v for *_, v in got), best)
        else:
            assert not got
        for a, b, v in got:
            assert np.isclose(x[a:b].sum(), v) and all(x[a:k].sum() > 0 for k in range(a + 1, b + 1)) and all(x[k:b].sum() > 0 for k in range(a, b))
        assert sorted(got) == sorted(got, key=lambda s: s[1]) and all(p[1] <= q[0] for p, q in zip(sorted(got), sorted(got)[1:]))


def test_toxicity_edges(edge, empty, docs, labels):
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    got = toxicity.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    known = toxicity.score(docs, model).join(labels, "doc_id").filter(~toxicity.held_out()).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in known]) > 0.9
    blank = toxicity.train(empty, labels)
    assert {r["score"] for r in toxicity.score(edge, blank).collect()} == {0.0}
    assert toxicity.passages(docs, model).filter("stop <= start").count() == 0


# near dedup


def near_rows():
    rng = random.Random(3)
    rows, base = [(i, t) for i, t in EDGE if i != 11 and i is not None], [words_text(rng, n) for n in (12, 40, 80, 160)]
    for k in range(160):
        w = base[k % 4].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = words_text(rng, 1)
        rows.append((100 + k, " ".join(w).upper() if k % 9 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, shingle, percent):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("signature", F.lit("clash")).repartition(5)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, shingle=shingle, percent=percent).collect())
    assert got == sorted(near_dedup.brute_force(rows, shingle, percent))


def test_near_duplicates_large_group_of_chained_copies(spark):
    rng = random.Random(9)
    w, rows = words_text(rng, 120).split(), []
    for k in range(60):  # each copy differs from the one before by a word, so ends of the chain aren't alike
        rows.append((k, " ".join(w)))
        w[(7 * k) % 120] = words_text(rng, 1) + str(k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, shingle=3, percent=85).collect())
    assert got == sorted(near_dedup.brute_force(rows, 3, 85))


def test_near_duplicates_edges(edge, empty, spark):
    got = near_dedup.near_duplicates(edge, shingle=3, percent=85).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == 6 and by[7]["component_id"] == 6 and by[1]["n_shingles"] == 0 and by[2]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(edge.filter("doc_id is not null"), shingle=3, percent=85)
    assert left.columns == edge.columns and left.filter("doc_id = 11").count() == 1 and left.filter("doc_id = 7").count() == 0


def test_keys_guarantee_the_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dedup.SYMBOLS, near_dedup.MAX_DISTANCE, replace=False)
        b[at] ^= 1
        rows.append((k, bytearray(a.tobytes()), bytearray(b.tobytes())))
    df = spark.createDataFrame(rows, "k int, a binary, b binary")
    assert df.filter(F.arrays_overlap(near_dedup.keys("a"), near_dedup.keys("b"))).count() == 200


# url filter


def test_url_rules(spark, empty):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://x.www.example.com/en/", "http://com", "http://com/", "http://q.net/es/3", "http://q.net/es", "http://notnet/es/", "http://h.org?x://y/z", "a://b/c#d?e", "x://\ny/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("www.example.com/en/", "allow")
    assert got[5][1:3] == ("", None) and got[6][2] == "com/" and got[7][2:] == ("net/es/", "block") and got[9][2] is None
    assert got[10][:2] == ("h.org", "") and got[11][:2] == ("b", "/c") and got[12][:2] == ("\ny", "/p")
    assert url_filter.judge(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count() == 0


def test_url_templates_generalise_merge_and_reject(spark):
    rows = [("h", f"/{b}/{i}", "block" if b in ("bad", "worse") else "allow") for b in ("bad", "worse", "good") for i in range(20)]
    rows += [("h", f"/user{chr(97 + i % 26)}{chr(97 + i // 26)}x/p", None) for i in range(60)] + [("h", "/bad/99/late", None), ("h", "/bad", None)]
    df = spark.createDataFrame(rows, "host string, path string, label string").select("host", url_filter.typed_path(F.col("path")).alias("typed"), "label")
    tree = url_filter.templates(df, min_share=0.02)
    by = {r["typed"]: r for r in tree.collect()}
    assert by["/bad/<n>"]["branch"] == by["/worse/<n>"]["branch"] != by["/good/<n>"]["branch"]
    assert {r["template"] for t, r in by.items() if t.startswith("/user")} == {"/*/p"}
    bad = {r["typed"] for r in url_filter.rejected_templates(tree, purity=0.8).collect()}
    assert {"/bad/<n>", "/worse/<n>", "/bad"} <= bad and "/good/<n>" not in bad


# licences


def test_licences(spark, docs, edge, empty):
    model = license_scan.train(docs)
    lines = [(1, "Intro.\nReleased under the MIT License.\nend"), (2, "licensed UNDER the apache license, version 2.0"), (3, "This license is odd"), (4, "nothing here"), (5, "Licensed under CC BY-NC 4.0."), (6, None)]
    got = {(r["doc_id"], r["line"]): (r["family"], r["confirmed"]) for r in license_scan.paragraphs(spark.createDataFrame(lines, "doc_id long, text string"), model).collect()}
    assert got == {(1, 1): ("mit", True), (2, 0): ("apache", True), (3, 0): ("unknown", False), (5, 0): ("cc-by-nc", True)}
    plain = {r["doc_id"]: r["families"] for r in license_scan.scan(docs, model).collect()}
    for r in docs.collect():
        want = sorted({f for line in (r["text"] or "").split("\n") for f in [max(zip(model.probabilities(line), license_scan.FAMILIES))[1]] if any(a in license_scan.grams(line) for a in license_scan.ANCHORS) and max(model.probabilities(line)[:-1]) >= 0.6 and f in model.confirmed(line)})
        assert plain.get(r["doc_id"], "") == ",".join(want)
    assert license_scan.scan(edge, model).count() == 0 and license_scan.scan(empty, license_scan.train(empty)).count() == 0


# decontamination


def test_decontamination_matches_brute_force(spark, edge):
    rng = random.Random(1)
    items = [(k, words_text(rng, n)) for k, n in enumerate((30, 12, 10, 4, 1, 30))] + [(7, None), (8, ""), (9, "one"), (9, "alpha beta gamma delta alpha beta gamma delta alpha beta x")]
    rows = [(200 + k, words_text(rng, 20) + " " + items[k % 6][1].upper().replace(" ", "-") + " " + words_text(rng, 5)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text").filter("doc_id is not null and doc_id <> 11"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth = sorted(decontaminate.brute_force([tuple(r) for r in df.collect()], items))
    for most in (2_000_000, 25):
        got = decontaminate.digest(decontaminate.occurrences(df, bench, max_broadcast_windows=most)).collect()
        assert sorted(tuple(r) for r in got) == truth


def test_decontamination_actions(spark, edge, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "start of text " + " ".join(f"w{i}" for i in range(12)) + " and the end of it which is long enough to stay in the corpus"), (2, " ".join(f"W{i}," for i in range(12))), (3, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert cut == {1: "start of text  and the end of it which is long enough to stay in the corpus", 3: "clean"}
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench, action="documents").collect()} == {3}
    assert decontaminate.decontaminate(edge, bench).count() == len(EDGE) and decontaminate.occurrences(empty, bench).count() == 0
    none = bench.filter("false")
    assert decontaminate.occurrences(edge, none).filter("n_hit > 0").count() == 0


# packing


def test_packing_round_trip(docs, edge, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    for df in (docs, edge.filter("doc_id is not null and doc_id <> 11")):
        pieces = packing.pack(df, tokenizer_path=path).collect()
        by = {}
        for p in pieces:
            assert p["length"] in {1 << k for k in range(11)} and len(p["ids"]) == p["length"] and p["offset"] == 0 and p["bucket"] == p["sequence_id"] >> 56
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            by.setdefault(p["doc_id"], []).append(p)
        assert len({p["sequence_id"] for p in pieces}) == len(pieces)
        for r in df.collect():
            at, ids = 0, []
            for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
                ids += p["ids"]
            assert ids == own.encode(r["text"] or "", add_special_tokens=False).ids + [0] and p["doc_tokens"] == at
    assert packing.pack(empty, tokenizer_path=path).count() == 0


def test_tokens_equal_the_tokenizer_on_odd_space():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, fast = Tokenizer.from_file(path), packing.Tokens(path, most=50)
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "Bé", "12", "'s", ".", ",", "漢", "\u00a0", "\u3000", "<|endoftext|>", "x"]) for _ in range(rng.randrange(0, 14)))
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


# quality


def test_quality_held_out(docs, labels, edge, empty):
    vectors = quality.unit_rows(quality.context_sums(docs))
    net = quality.train(docs, labels.filter(~quality.held_out()), vectors)
    got = quality.score(docs, vectors, net).join(labels, "doc_id").filter(quality.held_out()).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.85
    assert quality.score(edge, vectors, net).filter("score between 0 and 1").count() == len(EDGE)
    assert quality.context_sums(empty).any() == False and quality.score(empty, vectors, net).count() == 0  # noqa: E712
    assert {r["score"] for r in quality.score(edge, vectors, quality.train(empty, labels, vectors)).collect()} == {0.5}


# quality rules


def plain_counts(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    grams, covered = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]


def test_quality_rules_counts(docs, edge, empty):
    rows = [r["text"] for r in docs.collect()] + [t for _, t in EDGE] + ["a b c\na b c\na b c d", "x\n\nx\n \nx", "é é é é é"]
    for limit in (1 << 21, 100):
        got = np.concatenate([np.stack(quality_rules.measure(c), 1) for c in spans.chunks(pa.array(rows, pa.string()), limit)])
        assert got.tolist() == [plain_counts(t) for t in rows]
    assert quality_rules.apply_rules(edge).count() == len(EDGE) and quality_rules.apply_rules(empty).count() == 0


def test_bad_hosts_take_their_documents(spark):
    rng = random.Random(4)
    good = [(i, words_text(rng, 80), "fine") for i in range(40)] + [(100 + i, "short", "spam") for i in range(40)] + [(200, words_text(rng, 80), "spam"), (201, words_text(rng, 80), None), (202, "short", "rare")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(spark.createDataFrame(good, "doc_id long, text string, source string").withColumn("rate", F.lit(1))).collect()}
    assert kept[0] and not kept[100] and not kept[200] and kept[201] and not kept[202]


# SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, (tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())))
