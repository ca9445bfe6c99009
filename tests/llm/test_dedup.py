import random
import tracemalloc

import numpy as np
import pytest

from seriate.llm import near_duplicates as nd
from seriate.llm import suffix_dedup as sd
from seriate.llm.components import components
from seriate.llm.passages import _heads, cut, remove_passages, shared_in_pairs, shared_passages

from . import brute, data


def test_deep_shallow_orders_like_sorted():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 30))]
        order = sd.deep_shallow(strings, rng.choice([0, 2, 5, 24]))
        assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


@pytest.mark.parametrize("most", [1000, 1])
def test_repeats_are_removed_exactly(spark, most):
    values = data.texts()
    got = {r["doc_id"]: r for r in sd.remove_repeats(data.frame(spark, values, True), width=60, most_segments=most).collect()}
    assert len(got) == len(values)
    for k, want in enumerate(brute.repeats(values, 60)):
        r = got[7 * k + 3]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) == want


@pytest.mark.parametrize("most", [1000, 1])
@pytest.mark.parametrize("pairwise", [24, 0])
def test_shared_strings_are_shorter_and_of_other_texts(spark, monkeypatch, most, pairwise):
    monkeypatch.setattr(sd, "PAIRWISE", pairwise)
    values = [t for t in data.texts(11, 40) if t is None or len(t) < 2000]
    values += ["loop " * 40, "p q r s t " * 9 + "end", f"{values[0]} tail"]
    values += [f"{k} some seventy bytes that two texts, and no others, have in common here {k}" for k in "mn"]
    got = {r["doc_id"]: r for r in sd.remove_repeats(data.frame(spark, values, True), width=90, shared_width=48, most_segments=most).collect()}
    rows = [(7 * k + 3, t) for k, t in enumerate(values)]
    for (k, _), want, shared in zip(rows, brute.repeats(values, 90), brute.shared(rows, 48)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"])), r["n_shared"]) == (*want, shared)
    assert any(r["n_shared"] > r["n_removed"] == 0 for r in got.values()) and any(r["n_removed"] > r["n_shared"] == 0 for r in got.values())


def test_shared_passages_below_the_removed_width_are_told(spark):
    passage = " ".join(f"pass{k}" for k in range(51))
    rows = [(1, "a " + passage + " b"), (2, "c " + passage + " d"), (3, "x" * 399), (3, "x" * 399), (4, "y " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["n_shared"]) for r in sd.remove_repeats(df).collect())
    n = len(passage) + 2  # and the spaces about it
    assert 256 <= n < 400 and got == [(1, 0, n), (2, 0, n), (3, 0, 0), (3, 0, 0), (4, 800, 0)]


def test_repeats_of_equal_rows_and_null_ids(spark):
    text = " ".join(str(k) for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "x"), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in sd.remove_repeats(df, width=64).collect())
    assert got == [(0, len(text)), (1, len(text)), (1, len(text)), (2, 0)]
    assert sd.remove_repeats(df.limit(0), width=64).count() == 0


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(nd, "SMALL_BUCKET", small)
    monkeypatch.setattr(nd, "BLOCK", 3)
    values = data.texts(5, 80)
    rows = [(7 * k + 3, t) for k, t in enumerate(values)]
    want = brute.near(rows, 2, 80)
    got = {r["doc_id"]: r for r in nd.near_duplicates(data.frame(spark, values, True), n=2, percent=80).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, None), (8, " ")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, n=2).collect())
    assert got == [(0, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(200, 240)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, **{k: 100 for k in range(200, 240)}}


def test_passages_across_documents(spark):
    values = data.texts(9, 70)
    got = {r["doc_id"]: r for r in remove_passages(data.frame(spark, values, True), keep=["key"]).collect()}
    assert len(got) == len(values)
    tokens = {7 * k + 3: brute.WORD.findall((t or "").translate(brute.LOWER)) for k, t in enumerate(values)}
    holders = {}
    for k, w in tokens.items():
        for i in range(len(w) - 50):
            holders.setdefault(tuple(w[i : i + 51]), set()).add(k)
    for k, w in tokens.items():
        own = [holders[tuple(w[i : i + 51])] for i in range(len(w) - 50)]
        if any(len(h) > 1 for h in own):
            assert got[k]["n_repeated"] > 0
        if any(min(h) < k for h in own):
            assert got[k]["n_removed"] > 0
        r = got[k]
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"].encode()) and r["key"] == "key"
        if not r["n_removed"]:
            assert r["kept"] == (values[(k - 3) // 7] or "")


def test_passages_edges(spark):
    long_ = " ".join(f"t{k}" for k in range(80))
    df = spark.createDataFrame([(None, long_), (4, "x y. " + long_ + " z"), (4, "x y. " + long_ + " z"), (2, "q " + long_), (1, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["kept"], r["component_id"]) for r in remove_passages(df).collect())
    assert got == [(0, long_, None), (1, "", 1), (2, "q " + long_, 2), (4, "x y. z", 2), (4, "x y. z", 2)]
    assert remove_passages(df.limit(0)).count() == 0


def test_passages_whose_words_stand_in_earlier_documents(spark):
    rng = random.Random(4)
    unique = (f"u{k}" for k in range(10**6))
    own = lambda n: [next(unique) for _ in range(n)]
    rows, want = [], {}
    for k in range(30):
        if k % 2:  # three lines that earlier documents have singly
            lines = [own(20) for _ in range(3)]
            passage = sum(lines, [])
            earlier = [own(30) + line + own(30) for line in lines]
        else:  # a variant too far from two equal texts
            passage = own(90)
            other = list(passage)
            for at in range(rng.randrange(6), 90, 14):
                other[at] = next(unique)
            earlier = [own(10) + other + own(10)]
        rows += [(1000 * n + k, " ".join(w)) for n, w in enumerate(earlier)]
        first, second = (own(25), own(25)), (own(25), own(25))
        rows += [(1000 * (7 + n) + k, " ".join(x + passage + y)) for n, (x, y) in enumerate((first, second))]
        want[8000 + k] = " ".join(sum(second, []))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["kept"] for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: got[k] for k in want} == want
    assert all(got[k] == t for k, t in rows if k < 8000)


def test_equal_passages_whose_runs_stand_in_earlier_documents(spark):
    rng = random.Random(8)
    unique = (f"u{k}" for k in range(10**6))
    own = lambda n: [next(unique) for _ in range(n)]
    rows, want = [], {}
    for k in range(20):
        passage = own(rng.randrange(51, 80))
        # Every equal run of the passage stands in an earlier document of other words, twice in some.
        for n, at in enumerate(range(0, len(passage) - 34, 5)):
            part = passage[at : at + 35] if k % 2 else passage[at : at + 33]
            rows.append((1000 * n + k, " ".join(own(20) + part + own(20) + (part + own(9) if k % 3 == 0 else []))))
        for n in range(3):
            x, y = own(rng.randrange(0, 30)), own(rng.randrange(1, 30))
            rows.append((1000 * (50 + n) + k, " ".join(x + passage + y)))
            want[1000 * (50 + n) + k] = " ".join(x + (passage if n == 0 else []) + y)
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: got[k]["kept"] for k in want} == want
    assert all(got[k]["component_id"] == 50000 + k % 1000 for k in want)
    assert all(got[k]["kept"] == t and got[k]["component_id"] == k for k, t in rows if k < 50000)


def test_passages_with_inserted_deleted_and_replaced_words(spark):
    passage = [f"p{k}" for k in range(70)]
    edits = [passage[:35] + ["new"] + passage[35:], passage[:35] + passage[36:], passage[:34] + ["x", "y", "z"] + passage[37:], passage[:34] + ["x", "y", "z", "v"] + passage[36:]]
    rows = [(1, " ".join(["a0", "a1", *passage, "a2"]))]
    rows += [(k + 2, " ".join([f"b{k}", *edit, f"c{k}", f"d{k}"])) for k, edit in enumerate(edits)]
    rows.append((9, " ".join(passage[:30] + [f"far{k}" for k in range(30)] + passage[40:])))
    got = {r["doc_id"]: r for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k + 2]["kept"] for k in range(4)] == [f"b{k} c{k} d{k}" for k in range(4)]
    assert all(got[k]["component_id"] == 1 for k in range(1, 6)) and got[1]["n_repeated"] == len(" ".join(passage)) + 1
    assert got[9]["n_removed"] == 0 and got[9]["component_id"] == 9


def test_shared_passages_are_like_enough():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(50, 120))
        passage = rng.integers(1, 1 << 60, n).astype(np.uint64)
        at, gone, new = int(rng.integers(10, n - 14)), int(rng.integers(0, 4)), int(rng.integers(0, 4))
        edit = np.concatenate([passage[:at], np.arange(1, new + 1, dtype=np.uint64), passage[at + gone :]])
        x, y = np.concatenate([[np.uint64(7)] * 6, passage]).astype(np.uint64), np.concatenate([[np.uint64(9)] * 3, edit]).astype(np.uint64)
        sets = [{tuple(w[k : k + 5].tolist()) for k in range(len(w) - 4)} for w in (passage, edit)]
        covered = np.zeros(len(x), bool)
        for a, b, _, _ in shared_passages(x, y, 3):
            covered[a:b] = True
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and len(edit) >= 40:
            assert covered[6:].all() and not covered[:6].any()


def test_pairs_compared_at_once_are_those_compared_singly():
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(120):
        x = rng.integers(1, 1 << 60 if k % 3 else 60, int(rng.integers(0, 300))).astype(np.uint64)
        y = x.copy()
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(y) + 1))
            y = np.concatenate([y[:at], rng.integers(1, 1 << 60, int(rng.integers(0, 4))).astype(np.uint64), y[at + int(rng.integers(0, 4)) :]])
        pairs.append((x, y, int(rng.integers(-9, 9))))
    at_once = shared_in_pairs(*(list(c) for c in zip(*pairs)))
    assert at_once == [shared_passages(*p) for p in pairs] and any(at_once) and not all(at_once)


def test_repetitive_passages_are_compared_in_bounded_memory():
    x = np.tile(np.arange(1, 4, dtype=np.uint64), 1000)
    y = np.delete(x, [700, 1900])
    shared_passages(x[:300], x[:299])
    tracemalloc.start()
    found = shared_passages(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    covered = np.zeros(len(x), bool)
    for a, b, _, _ in found:
        covered[a:b] = True
    assert covered.sum() >= len(x) - 5
    assert peak < 20e6


def test_heads_by_hash_are_the_first_occurrences(spark):
    rng = random.Random(6)
    rows = sorted({(k, 7 * k - 50, rng.randrange(1 << 20), rng.randrange(40)) for k in range(20) for _ in range(9)})
    found = spark.createDataFrame([(*r, not any(o[0] == r[0] and o[3] == r[3] and o[2] < r[2] for o in rows)) for r in rows], "id long, th int, at int, key long, first boolean").repartition(5)
    want, got = _heads(found, False), _heads(found, True)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_cut_keeps_other_bytes():
    assert cut("a  b\nc d", [{"lost": True, "first": 1, "stop": 3}])[4] == "a  d"
