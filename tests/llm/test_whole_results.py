"""Cases in which the corpus operators once did less than the whole job."""

import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hearthspark.llm import decontaminate, language_id, near_dedup, pii
from hearthspark.llm.common import bounded_sample

BASE62 = string.ascii_letters + string.digits


def some(rng, n, alphabet=BASE62):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_pii_finds_random_keys(spark):
    rng = random.Random(3)
    make = {"ghp": lambda: "ghp_" + some(rng, 36), "sk": lambda: "sk-" + some(rng, 48), "cloud": lambda: some(rng, 40), "akia": lambda: "AKIA" + some(rng, 16, string.ascii_uppercase + "234567")}
    keys = {(k, i): f() for k, f in make.items() for i in range(25)}
    rows = [(n, f'token = "{v}" end') for n, v in enumerate(keys.values())]
    plain = ["src/main/java/com/example/Application", "a-rather-long-hyphenated-word-group", "we use sk-learn and eyJ here", "-" * 40]
    rows += [(1000 + n, f"see {v} for more") for n, v in enumerate(plain)]
    rows += [(2000 + n, f"see {1990 + n}/short/history/of/a/country/{n} for more") for n in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    missed = [k for n, (k, v) in enumerate(keys.items()) if "secret:" not in found[n] or v in masked[n]]
    assert not missed
    assert all(masked[i] == t for i, t in rows if i >= 1000)


def test_near_duplicates_with_a_null_id_in_a_copy_group(spark):
    rng = random.Random(5)
    words = [some(rng, 6) for _ in range(80)]
    near = [*words[:79], "other"]
    rows = [(None, " ".join(words)), *((i, " ".join(words)) for i in range(3, 40)), (1, " ".join(near)), (None, "nothing like the others at all"), (None, "nothing like the others at all"), (50, "on its own here today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle=3, percent=85).collect()
    assert len(got) == len(rows)
    want = {d: c for d, _, c, _ in near_dedup.brute_force([r for r in rows if r[0] is not None], 3, 85)}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want and want[39] == 1
    assert sorted((r["component_id"] or 0, r["kept"]) for r in got if r["doc_id"] is None) == [(0, True), (0, True), (1, False)]
    left = near_dedup.drop_near_duplicates(df, shingle=3, percent=85)
    assert sorted((r["doc_id"] or 0, r["text"][:7]) for r in left.collect()) == [(0, "nothing"), (1, " ".join(words)[:7]), (50, "on its ")]


def test_samples_are_full_among_copies(spark):
    df = spark.range(200_000).select(F.concat(F.lit("text "), (F.col("id") % 400).cast("string")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(30).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"), F.lit("fr").alias("lang"))
    got = bounded_sample(df.union(few), F.col("text"), 250, "lang")
    assert sum(r["lang"] == "en" for r in got) == 250 and sum(r["lang"] == "fr" for r in got) == 30
    assert len({r["text"] for r in got}) == 280


def test_texts_without_letters_have_no_language_at_any_length(spark):
    texts = {y: [" ".join(some(random.Random(f"{y}{i}{k}"), 5, a) for k in range(40)) for i in range(20)] for y, a in (("xx", "abcdef"), ("yy", "uvwxyz"))}
    model = language_id.fit(texts, rounds=5)
    column = pa.array([f"{ch} " * n for n in (49, 50, 500) for ch in ("—", "•", "😀", "٣")] + ["漢字 " * 60, "— " * 60 + "é", "ab " * 60])
    lang, score = language_id.verdicts(column, model)
    assert lang[:12] == ["und"] * 12 and not any(score[:12]) and "und" not in lang[12:]


def test_decontamination_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    w = [f"w{k}" for k in rng.permutation(400)]
    items = [("a", " ".join(w[0:24])), ("b", " ".join(w[16:40])), ("c", " ".join(w[40:60])), ("d", None), ("e", " ".join(w[5:9] + w[60:75]))]
    texts = [" ".join(w[0:40]) + " " + " ".join(w[100:200]), " ".join(w[0:24] + w[200:210] + w[40:60] + w[210:216]), " ".join(w[5:9] + w[16:40] + w[60:75] + w[300:400]), " ".join(w[150:200]), None]
    rows = [(k % 3 if k != 1 else None, t, k) for k, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    truth = sorted(decontaminate.brute_force([(k, t) for _, t, k in rows], items))
    one = {r["k"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert 1 not in one and one[0] == one[5] == " " + " ".join(w[100:200])
    for most in (1, 20, 30, 2_000_000):
        assert {r["k"]: r["text"] for r in decontaminate.decontaminate(df, bench, max_broadcast_windows=most).collect()} == one
        got = decontaminate.digest(decontaminate.occurrences(df, bench, id_col="k", max_broadcast_windows=most)).collect()
        assert sorted(tuple(r) for r in got) == truth
        assert decontaminate.occurrences(df, bench, max_broadcast_windows=most).count() == len(rows)
