import random
import re
from binascii import crc32
from collections import Counter

import pytest

import corpus_pipeline
from seriate.llm import fingerprints, toxicity
from seriate.llm.common import rows_with

from . import brute, data

STEMS = ["grobia", "zlostr", "vekuat"]


def labelled(n=400, seed=1):
    """(documents, labels) rows; toxic texts hold stems with changing endings."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        own = data.words(rng, rng.randrange(20, 60), 3000)
        toxic = rng.random() < 0.25
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(STEMS) + rng.choice("abcdefgh"))
        docs.append((k, " ".join(own)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_is_learnt_without_the_held_out_fold(spark):
    docs, labels = labelled()
    documents = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "x " * 9000)], "doc_id long, text string")
    held = lambda k: crc32(str(k).encode()) % 5 == 0
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents, table).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(k) for k, r in got.items())
    known = [(got[k]["predicted"], t) for k, _, t in labels if held(k)]
    assert sum(p == t for p, t in known) >= 0.93 * len(known)
    # Other labels in the held-out fold change nothing.
    wrong = spark.createDataFrame([(k, q, 1 - t if held(k) else t) for k, q, t in labels] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, wrong).collect()}
    assert again == {k: r["score"] for k, r in got.items()}


def test_toxicity_without_both_labels_is_constant(spark):
    docs, _ = labelled(20)
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    for value, score in ((0, 0.0), (1, 1.0), (None, 0.0)):
        table = spark.createDataFrame([(k, 1, value) for k, _ in docs], "doc_id long, quality int, toxic int")
        assert {r["score"] for r in toxicity.toxicity(documents, table).collect()} == {score}


def weighted(text):
    return Counter(w for w in re.split("[ \t-\r]+", (text or "").lower()) if w)


def jaccard(x, y):
    a, b = weighted(x), weighted(y)
    most = sum(max(a[k], b[k]) for k in a | b)
    return sum(min(a[k], b[k]) for k in a | b) / most if most else 1.0


def test_fingerprints_estimate_weighted_similarity(spark):
    values = data.texts(12, 40)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(data.frame(spark, values, True)).collect()}
    assert len(got) == len(values)
    order, errors = sorted(range(len(values)), reverse=True), []
    for place, k in enumerate(order):
        text, following = values[k] or "", values[order[(place + 1) % len(order)]] or ""
        half = len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], got[7 * k + 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(edited.encode()))
        errors += [abs(r["near_edited"] - jaccard(text, edited)), abs(r["near_next"] - jaccard(text, following))]
        assert all(got[7 * j + 3]["fingerprint"] == r["fingerprint"] for j in order if (values[j] or "") == text)
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.3


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = fingerprints.fingerprints(one).collect()
    assert (r["n_chars"], r["edited_sha256"], r["near_next"]) == (3, brute.sha(b"a a"), 1.0)
    assert fingerprints.fingerprints(one.limit(0)).count() == 0
    many = spark.createDataFrame([(None, "x y"), (2, "p q"), (2, "p q"), (2, "r"), (1, None)], "doc_id long, text string")
    rows = fingerprints.fingerprints(many).collect()
    assert len(rows) == 5 and len({tuple(r) for r in rows if r["n_chars"] == 3 and r["doc_id"] == 2}) == 1


def test_rows_with_keeps_all_that_are_wanted(spark):
    df = spark.range(5000).selectExpr("id", "cast(id as string) as text").repartition(7)
    wanted = spark.range(0, 5000, 97).toDF("id")
    got = {r["id"] for r in rows_with(df, ["id"], wanted).collect()}
    assert got >= set(range(0, 5000, 97)) and len(got) < 80
    assert rows_with(df, ["id"], wanted.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, labels = labelled(160, 4)
    rng = random.Random(8)
    clean = [t for (k, t), (_, _, toxic) in zip(docs, labels) if not toxic]
    passage = " ".join(data.words(rng, 60, 90_000))
    extra = [clean[0], clean[0] + " more", " ".join(data.words(rng, 30)) + " " + passage, " ".join(data.words(rng, 30)) + " " + passage + " end", None, ""]
    docs += [(1000 + k, t) for k, t in enumerate(extra)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(docs), {k: t for k, _, t in labels}


def test_pipeline_stages(spark, corpus):
    path, docs, toxic = corpus
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, path)
        now.write.parquet(f"{path}/stage{k}")
        now = spark.read.parquet(f"{path}/stage{k}")
        kept.append({r["doc_id"]: r for r in now.collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == columns
    rejected = set(docs) - set(kept[0])
    assert sum(toxic.get(k, 0) for k in rejected) >= 0.9 * sum(toxic.values()) and sum(not toxic.get(k, 0) for k in rejected) <= 3
    assert 1000 not in kept[1] and 1001 not in kept[1] and set(kept[1]) <= set(kept[0])
    assert set(kept[2]) == set(kept[1]) and kept[2][1002]["text"] == docs[1002] and len(kept[2][1003]["text"]) < len(docs[1003]) - 200
    assert kept[2][1003]["n_chars"] == len(kept[2][1003]["text"]) and set(kept[3]) == set(kept[2])
