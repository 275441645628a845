"""Phrases, spelling variants and WARC packages against brute force, round trips and odd inputs."""

import collections
import gzip
import hashlib
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspark.llm import phrases, queries, spelling, warc_zip
from hearthspark.llm.common import release, scratch

SMALL = "/root/testdata/sf0.001"
CAPITALS = {k: k + 32 for k in range(65, 91)}


# phrases


def all_phrases(rows, least, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(CAPITALS)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return {x: a for x, a in f.items() if a >= least}, n


def brute_collocations(rows, least, top, percent=100):
    f, n = all_phrases(rows, least)
    gone = {(g, p[i:j]) for (g, p), a in f.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * f[g, p[i:j]]}
    out = collections.defaultdict(list)
    for (g, p), a in f.items():
        if len(p) > 1 and (g, p) not in gone:
            s, k = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            out[g].append((-s, -a, " ".join(p).encode(), a, f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, i + 1, p.decode(), a, l, r, n[g], -s) for g, x in out.items() for i, (s, _, p, a, l, r) in enumerate(sorted(x)[:top]))


def got_collocations(df, **k):
    return sorted(tuple(r) for r in phrases.collocations(df, **k).collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(2)
    parts = ["a", "B", "bb ", "é", " ", "\t", ".", ",\n", " c ", " the the", " x", "\x0b", "漢 "]
    rows = [(i, rng.choice(["en", None, "und"]), "".join(rng.choice(parts) for _ in range(400))) for i in range(24)]
    return [*rows, (None, None, None), (3, "en", ""), (3, "xx", "a b " * 20_000), (3, "xx", "a b " * 20_000), (9, "", "one two")]


def test_phrases_equal_brute_force(spark, phrase_rows):
    df = spark.createDataFrame([(*r, 1, "p", 5) for r in phrase_rows], "doc_id long, lang string, text string, n int, phrase string, k int")
    rows = [r[1:] for r in phrase_rows]
    for percent in (100, 70):
        assert got_collocations(df, least=5, top=10**6, sample_least=2, percent=percent) == brute_collocations(rows, 5, 10**6, percent)
    assert got_collocations(df, least=5, top=3) == brute_collocations(rows, 5, 3)


def test_border_failures_are_closed_by_further_passes(spark, phrase_rows):
    """A sample that proposes almost nothing costs passes and no phrase."""
    df = spark.createDataFrame(phrase_rows, "doc_id long, lang string, text string")
    want = all_phrases([r[1:] for r in phrase_rows], 5)[0]
    for part, least in ((1, 5), (8, 2), (1 << 30, 1)):
        found, _, passes = phrases.frequent_phrases(df, least=5, sample_part=part, sample_least=least)
        assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found.collect()} == want
        assert (passes == 0) == (part == 1)


def test_clashing_hashes_change_no_count(spark, phrase_rows, monkeypatch):
    df = spark.createDataFrame(phrase_rows, "doc_id long, lang string, text string")
    monkeypatch.setattr(phrases, "_LEAST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "_MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "hot_pairs", lambda *a, **k: phrases.Bitmap(np.full((1 << 16) // 8, 255, np.uint8), 1 << 16))
    monkeypatch.setattr(phrases, "bitmap_of", lambda *a, real=phrases.bitmap_of, **k: real(*a, **k)._replace(words=np.full((1 << 15) // 8, 255, np.uint8)))
    assert got_collocations(df, least=5, top=10**6) == brute_collocations([r[1:] for r in phrase_rows], 5, 10**6)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**15 + 3, 10**12 + 9, 10**13 + 1), (3, 10**18, 3, 3), (100, 100, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s"))
    for a, n, l, r, s in df.collect():
        want = 1000 * a * n // (l * r)
        assert s == want or want >= 1 << 63


def test_no_phrases(spark):
    assert got_collocations(spark.createDataFrame([], "doc_id long, lang string, text string")) == []
    assert got_collocations(spark.createDataFrame([(1, "en", None), (2, None, " \t\n")], "doc_id long, lang string, text string"), least=1) == []


# spelling variants


def brute_variants(rows):
    c = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(CAPITALS)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                c[w] += 1
    v = {w: n for w, n in c.items() if n >= 2}
    cut, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in v:
        for k in range(len(w)) if len(w) < 1000 else ():
            cut[k, w[:k] + w[k + 1 :]].add(w)
    for (_, rest), ws in cut.items():
        for a in ws:
            near[a] |= ws - {a}
            if rest in v:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w in v:
        best = min(((-v[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * v[w] else None
    out = {}
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None)
    return out


def got_variants(df, **k):
    rows = spelling.variants(df, **k).collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def variant_rows():
    rng = random.Random(1)
    few = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(150))) for i in range(30)]
    chain = [(100, "chainword " * 1500 + "chainwort " * 120 + "chainwart " * 9 + "Chaínwart " * 2), (None, "naïvement ÀÉÎÕÜß× aaaaaaa aaaaaaaa " * 3), (None, None), (5, ""), (5, "x" * 8), (7, "漢字 ａｂｃｄｅｆｇｈ abcdefgĀhijklmno " * 2)]
    return few + chain + [(200, "repeated repeatedd"), (200, "repeated repeatedd")]


def test_variants_equal_brute_force(spark, variant_rows):
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in variant_rows], "doc_id long, text string, word string, n int, rest int")
    want = brute_variants(variant_rows)
    assert any(f and r != f for f, r, *_ in want.values())  # a chain of forms
    assert got_variants(df) == want
    assert got_variants(df, most=20) == want  # hot partitions are divided, some of them again and again


def test_very_long_words(spark):
    a, b = "x" * 5000, "x" * 2000 + "y" + "x" * 2999
    rows = [(i, f"{a} {b} {a}x {b[:-1]}") for i in range(3)]
    want = {a: {b, a + "x"}, b: {a, b[:-1]}, a + "x": {a}, b[:-1]: {b}}
    got = {w: r[3] for w, r in got_variants(spark.createDataFrame(rows, "doc_id long, text string")).items() if len(w) > 100}
    c = collections.Counter(w for i, t in rows for w in t.split() if zlib.crc32(f"{i}:{w}".encode()) % 31)
    assert c and {w: sum(c[x] > 1 for x in near) for w, near in want.items() if c[w] > 1}.items() <= got.items()


def test_acceptor_is_minimal_and_composes(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    rests = np.zeros((len(words), 6), np.uint8)
    for k, w in enumerate(words):
        rests[k, : len(w)] = list(w.encode())
    a = spelling.Acceptor(rests, np.array([len(w) for w in words]), np.zeros(len(words), np.int64))
    right = {}
    for w in words:  # states of the minimal acceptor: sets of rests after each prefix
        for d in range(len(w) + 1):
            right.setdefault(w[:d], set()).add(w[d:])
    assert a.n == len({frozenset(x) for x in right.values()})
    assert a.size[a.initial].tolist() == [len(words)]
    near = lambda x, y: len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 or abs(len(x) - len(y)) == 1 and any(max(x, y, key=len)[:k] + max(x, y, key=len)[k + 1 :] == min(x, y, key=len) for k in range(max(len(x), len(y))))  # noqa: E731, B905
    for replaces in (True, False):
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j]) and (replaces or len(words[i]) != len(words[j]))}
        assert set(map(tuple, spelling.compose(a, np.array([replaces])).tolist())) == want


def test_no_variants(spark):
    assert got_variants(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert got_variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")) == {}


# WARC packages

PAGES = [
    (5, "http://a.b/x", "p" * 100), (3, "http://a.b/y\r\nz", "p" * 100), (9, None, "p" * 100), (3, "http://again", "p" * 100), (1, "u", "short"), (2, "u", "short"), (7, "é", "é" * 50), (8, "é", "é" * 50), (4, "", None), (6, "", ""),
    (None, "null id", "q" * 200), (11, "u", "q" * 200), (12, "u", "x\r\n\r\ny" * 40), (13, "u", "WARC/1.1\r\n\r\n" * 20), (14, "big", "lorem " * 500_000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "r", 1) for p in PAGES], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(3)


@pytest.fixture
def folder(spark):
    path = scratch(spark, "test-warc")
    yield path
    release(path)


def expected_digest():
    first = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"package_bytes": 300}, {"package_records": 2}])
def test_pages_come_back(spark, pages, folder, limits):
    manifest = warc_zip.write_packages(pages, folder, **limits)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    for packages in (manifest, warc_zip.list_packages(spark, folder)):
        records = warc_zip.read_records(packages, span_bytes=1000)
        got = warc_zip.digest(warc_zip.resolve(records), "bigint")
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected_digest()
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in records.filter("record_type = 'response'").collect()}
    assert texts["14"] == PAGES[-1][2] and texts["12"] == "x\r\n\r\ny" * 40


def test_packages_are_valid_zip_files(spark, pages, folder):
    path = warc_zip.write_packages(pages.coalesce(1), folder).first()["path"]
    with zipfile.ZipFile(path.removeprefix("file:")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
        assert len(z.read(warc_zip.INDEX).splitlines()) == len(PAGES)
    found = warc_zip.members(spark.createDataFrame([(path,)], "path string")).collect()
    assert {m["name"] for m in found} == {warc_zip.DATA, warc_zip.INDEX, "datapackage.json"}


def _record(i, body):
    return warc_zip.record_bytes("response", str(i), "u", body, hashlib.sha256(body).hexdigest(), None, "2020-01-01T00:00:00Z")


def _package(path, *, zip64=False, before=b"", deflated=False, index=True, plain=False, comment=b"", monkeypatch=None):
    if zip64:  # every size and offset, and the number of entries, goes to the ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    parts = [_record(i, b"body %d " % i * (i + 1)) for i in range(5)]
    parts = parts if plain else [gzip.compress(p) for p in parts]
    name, lines, at = "archive/data.warc" + ".gz" * (not plain), [], 0
    for p in parts:
        lines.append('k 2020 {"filename": "%s", "offset": "%d", "length": "%d"}' % (name[8:], at, len(p)))
        at += len(p)
    with open(path, "wb") as f:
        f.write(before)
    with zipfile.ZipFile(path, "a" if before else "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
        z.comment = comment
        if index:
            z.writestr("indexes/index.cdxj", "\n".join(lines))
        z.writestr(name, b"".join(parts))
        z.writestr("notes.txt", "x" * 50)


@pytest.mark.parametrize("kind", [{}, {"zip64": True}, {"before": b"#!/bin/sh\n" * 30}, {"zip64": True, "before": b"x" * 777}, {"deflated": True}, {"index": False}, {"plain": True}, {"plain": True, "index": False}, {"comment": b"PK\x05\x06" + b"c" * 40}])
def test_packages_of_other_writers(spark, tmp_path, monkeypatch, kind):
    path = str(tmp_path / "p.zip")
    _package(path, monkeypatch=monkeypatch, **kind)
    monkeypatch.undo()
    data = open(path, "rb").read()
    assert (b"PK\x06\x06" in data and b"PK\x06\x07" in data) == bool(kind.get("zip64"))
    rows = warc_zip.read_records(spark.createDataFrame([(path,)], "path string"), span_bytes=64).collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in rows) == [(str(i), b"body %d " % i * (i + 1)) for i in range(5)]


def test_offsets_that_count_from_the_package(spark, tmp_path):
    """Bytes put before a finished package shift all its offsets."""
    path = str(tmp_path / "p.zip")
    _package(path)
    data = open(path, "rb").read()
    open(path, "wb").write(b"y" * 1234 + data)
    assert warc_zip.read_records(spark.createDataFrame([(path,)], "path string")).count() == 5


def test_broken_packages(spark, tmp_path):
    good, cut, empty, lies = (str(tmp_path / f"{n}.zip") for n in ("good", "cut", "empty", "lies"))
    _package(good)
    data = open(good, "rb").read()
    open(cut, "wb").write(data[: len(data) // 2])
    open(empty, "wb").close()
    at = data.rfind(b"PK\x05\x06")
    open(lies, "wb").write(data[: at + 16] + struct.pack("<I", len(data) + 5) + data[at + 20 :])
    packages = spark.createDataFrame([(p,) for p in (good, cut, empty, lies)], "path string")
    kinds = collections.Counter((r["path"].rpartition("/")[2], r["record_type"]) for r in warc_zip.read_records(packages, unreadable="report").collect())
    assert kinds == {("good.zip", "response"): 5, ("cut.zip", "unreadable"): 1, ("empty.zip", "unreadable"): 1, ("lies.zip", "unreadable"): 1}
    with pytest.raises(Exception, match="Unreadable"):
        warc_zip.read_records(packages).collect()


def test_no_pages(spark, pages, folder):
    manifest = warc_zip.write_packages(pages.limit(0), folder)
    assert warc_zip.digest(warc_zip.resolve(warc_zip.read_records(manifest)), "bigint").collect() == []


@pytest.mark.parametrize("name", ["op11_phrases", "op12_spelling_variants", "op13_warc_zip"])
def test_new_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=str) == sorted(map(tuple, df.collect()), key=str)
