import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriate.llm import packing as P

from . import data


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_the_counts_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 20_000), np.clip(rng.lognormal(5.5, 1, 20_000), 1, 1024).astype(int), rng.integers(400, 1025, 5_000)][seed]
    counts = np.bincount(lengths, minlength=1025)
    used, total = np.zeros(1025, int), 0
    for config, n in P.plan(counts, 1024).items():
        assert sum(size * k for size, k in config) <= 1024
        total += n
        for size, k in config:
            used[size] += n * k
    assert (used == counts).all()
    bound = max(-(-int((counts * np.arange(1025)).sum()) // 1024), int(counts[513:].sum()))
    assert bound <= total <= 1.01 * bound
    assert total <= sum(P.best_fit(counts, 1024).values())


def test_plan_has_fewer_sequences_than_best_fit():
    # Best fit puts 500 with 500 and leaves 300 to threes; the program pairs them fully: 500 + 300 + 224.
    counts = np.zeros(1025, int)
    counts[[500, 300, 224]] = 4000
    assert sum(P.plan(counts, 1024).values()) < sum(P.best_fit(counts, 1024).values())


def test_dual_bound_holds_where_size_says_nothing():
    # Three of 300 fit a sequence, whatever room is left: the size bound is 879, the fewest are 1000.
    counts = np.zeros(1025, int)
    counts[300] = 3000
    *_, (program, bound) = P.covering_program(counts, 1024)
    assert abs(bound - 1000) < 1e-6
    assert P.plan(counts, 1024) == {((300, 3),): 1000}


@pytest.mark.parametrize("seed", range(20))
def test_dual_bound_is_below_the_fewest_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(2, 11, 7).tolist()

    def fewest(rest: tuple, rooms: tuple) -> int:
        if not rest:
            return len(rooms)
        size, rest = rest[0], rest[1:]
        tries = {(*rooms[:k], r - size, *rooms[k + 1 :]) for k, r in enumerate(rooms) if r >= size} | {(*rooms, 12 - size)}
        return min(fewest(rest, t) for t in {tuple(sorted(t)) for t in tries})

    counts = np.bincount(lengths, minlength=13)
    exact = fewest(tuple(lengths), ())
    assert all(bound <= exact + 1e-6 for _, bound in P.covering_program(counts, 12))
    assert exact <= sum(P.plan(counts, 12).values()) <= exact + 1


def test_plan_of_nothing():
    assert P.plan(np.zeros(1025, int), 1024) == {}


def test_pieces_are_packed_without_gaps(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    values = data.texts(4, 40)
    found = P.pieces(data.frame(spark, values, True), path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = P.pack(found).collect()
    library = Tokenizer.from_file(path)
    sequences, own = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    for k, t in enumerate(values):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for number, r in enumerate(sorted(own[7 * k + 3], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (number, at) and (number == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert P.pack(found.limit(0)).count() == 0
