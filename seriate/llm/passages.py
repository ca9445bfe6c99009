"""Operator 10: removal of passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is any run of WINDOW five-word shingles, so that a passage is met wherever it stands in a line. A band picks the least value
of its permutation over a paragraph's shingles; paragraphs that follow each other mostly pick the same. Its key is that value with the
least one of the SIDE shingles before it, and, as a second key, of those after it, so that a common phrase in another context is no
collision; a paragraph holds one of both sides whole. Besides, of every LEAST_EQUAL words one run of EQUAL words is a key, so that equal
passages meet whatever else holds their parts. Collisions are joined to the first document with the key, and equal runs that this document
holds in other surroundings, with more words on either side, to the first one with these; those of two documents at one distance are a chain, whose stretches are compared word by word, small gaps bridged, and confirmed on the exact Jaccard similarity of
their shingles; where more shingles are common than that explains, the stretches are aligned with insertions and deletions, and the
aligned spans are confirmed alike. The first document keeps a passage, the others lose it; components of documents linked so are named
by their least id.
"""

from __future__ import annotations

from bisect import insort
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_heavy, mix, rows_with, shingles, staged, text_slices, texts_of, words
from .components import components

#: Words of a shingle, shingles of a paragraph, bands of one permutation each.
SHINGLE, WINDOW, BANDS = 5, 40, 2
#: Shingles before or after a key's own of which the least is part of the key: half a paragraph has as many on one side at least.
SIDE = 16
#: Words of a run that is a key by itself, and the words of a passage that holds a picked run for certain.
EQUAL, LEAST_EQUAL = 28, 51
#: Words before or after such a run that are part of a longer key: LEAST_EQUAL words about a run have as many on one side at least.
MORE = 12
#: The least words of a passage, the least similarity, and the longest gap (in words) bridged within it.
LEAST_WORDS, LEAST_LIKENESS, GAP = 40, 0.8, 2
#: The least shingles that two passages of LEAST_WORDS have in common.
LEAST_SAME = ceil(2 * (LEAST_WORDS - SHINGLE + 1) * LEAST_LIKENESS / (1 + LEAST_LIKENESS) - 1e-9)
#: Words that are compared beyond the outermost keys of a chain: a paragraph and a gap at least.
REACH = 60
#: How many words an alignment may leave a chain's distance by, and how far apart distances of one chain are at most.
BAND, LANE = 20, 16
#: Words of pairs that are compared at once; a longer pair is compared alone.
PAIR_WORDS = 1 << 15


def minima(x: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Places in x that hold the least of some run of ``window`` values of one row; a row with fewer values is one run."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, n.bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = (x & ~mask) | np.arange(n, dtype=np.uint64)
    lead = np.ones(n, bool)
    lead[1:] = of[1:] != of[:-1]
    begin = np.flatnonzero(lead)
    stop = np.append(begin[1:], n)
    step, ahead = 1, low
    while 2 * step <= window and len(ahead) > step:
        ahead = np.minimum(ahead[:-step], ahead[step:])
        step *= 2
    rest = window - step
    found = []
    if step * 2 > window and len(ahead) > rest:
        ahead = np.minimum(ahead[: len(ahead) - rest], ahead[rest:]) if rest else ahead
        found.append(ahead[of[: len(ahead)] == of[window - 1 : window - 1 + len(ahead)]])
    short = stop - begin < window
    found.append(np.array([low[a:b].min() for a, b in zip(begin[short].tolist(), stop[short].tolist())], dtype=np.uint64))
    return np.unique(np.concatenate(found) & mask).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, key) of what texts are met by: paragraphs' least shingles with the least one before or after them, and equal runs."""
    _, _, hashes, rows = words(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    begin = np.cumsum(counts) - counts  # first word of a row
    keys, of, first = shingles(hashes, rows, SHINGLE)
    n, out = len(keys), []
    size = np.bincount(of, minlength=len(offsets) - 1)
    last = np.cumsum(size)  # where a row's shingles end
    for band in range(BANDS):
        with np.errstate(over="ignore"):
            x = mix(keys * np.uint64(2 * (0x7FEB352D + 0x846CA68B * band) + 1) + np.uint64(band))
        at = minima(x, of, WINDOW)
        least = x.copy()
        step = 1
        while 2 * step <= SIDE:
            least[: n - step] = np.minimum(least[: n - step], least[step:])
            step *= 2
        for side, place in ((0, at - SIDE), (1, at + 1)):
            whole = (place >= last[of[at]] - size[of[at]]) & (place + SIDE <= last[of[at]])
            own = at[whole]
            with np.errstate(over="ignore"):
                key = mix(x[own] * np.uint64(0xD6E8FEB86659FD93) + least[place[whole]] * np.uint64(2) + np.uint64(side))
            out.append((of[own], first[own] - begin[of[own]], key))
    runs, of, first = shingles(hashes, rows, EQUAL)
    at = minima(runs, of, LEAST_EQUAL - EQUAL + 1)
    out.append((of[at], first[at] - begin[of[at]], runs[at]))
    # The lowest bit of a key tells equal runs.
    row, word, key = (np.concatenate(c) for c in zip(*out))
    one = np.uint64(1)
    key = np.where(np.arange(len(key)) < len(key) - len(at), key & ~one, key | one)
    return row, word, key


def longer_runs(x: bytes, y: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first word, key) of the equal runs of two sequences of 64-bit word hashes, with MORE words before or after them, that differ in y.

    ``places`` are the first words of a run in x and y. What reaches beyond x has no key.
    """
    found = []
    for i, j in places:
        for first, there, a, b in ((i - MORE, j - MORE, i - MORE, j - MORE), (i, j, i + EQUAL, j + EQUAL)):
            if first < 0 or 8 * (first + EQUAL + MORE) > len(x):
                continue
            if there < 0 or x[8 * a : 8 * (a + MORE)] != y[8 * b : 8 * (b + MORE)]:
                found.append((first, xxhash.xxh64_intdigest(x[8 * first : 8 * (first + EQUAL + MORE)])))
    return found


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(id, th, at, key, first) of every anchor; ``first`` tells the first place of a key in its text."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                row, at, key = anchors(data, offsets)
                if len(row):
                    rows = pa.array(row + a)
                    first = np.zeros(len(row), bool)
                    first[np.unique(key ^ mix(row.astype(np.uint64)), return_index=True)[1]] = True
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(first)], ["id", "th", "at", "key", "first"])

    return texts.select("id", "th", "text").mapInArrow(run, f"id {kind}, th int, at int, key long, first boolean")


def _stretches(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, th, lo, hi, hashes) of the wanted stretches (id, th, lo, hi): 64-bit word hashes. Each text is read once for all of its own."""
    by_text = wanted.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
    kind = wanted.schema["id"].dataType.simpleString()
    names = ["id", "th", "lo", "hi", "hashes"]

    def run(batches):
        for batch in batches:
            asked = batch.column(2)
            for a, b, data, offsets in text_slices(batch.column(3)):
                _, _, hashes, rows = words(data, offsets)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                own = asked.slice(a, b - a)
                many = np.diff(own.offsets.to_numpy())
                spans = own.flatten()
                lo, hi = spans.field("lo"), spans.field("hi")
                row = np.repeat(np.arange(b - a), many)
                begin = np.minimum(np.maximum(lo.to_numpy(), 0) + cuts[row], cuts[row + 1])
                stop = np.maximum(np.minimum(hi.to_numpy() + cuts[row], cuts[row + 1]), begin)
                at = pa.array(row + a)
                for k in range(0, len(row), 2000):
                    part = slice(k, k + 2000)
                    found = [hashes[x:y].tobytes() for x, y in zip(begin[part].tolist(), stop[part].tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at[part]), batch.column(1).take(at[part]), lo[part], hi[part], pa.array(found, pa.binary())], names)

    return texts.join(by_text, ["id", "th"]).select("id", "th", "own", "text").mapInArrow(run, f"id {kind}, th int, lo long, hi long, hashes binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of the shingles of two runs of words, given by their hashes."""
    a, b = (np.unique(shingles(h, np.zeros(len(h), np.int64), SHINGLE)[0]) for h in (x, y))
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / max(1, len(a) + len(b) - same)


def _joined(parts: list[np.ndarray], begin: np.ndarray, size: int, fill: int) -> np.ndarray:
    """Rows of 64-bit hashes in one array, each from its place in ``begin`` on, with ``fill`` between them."""
    out = np.full(size, fill, np.uint64)
    at = np.repeat(begin, [len(p) for p in parts])
    out[at + np.arange(len(at)) - np.repeat(np.cumsum([0, *(len(p) for p in parts[:-1])]), [len(p) for p in parts])] = np.concatenate(parts)
    return out


def common_passages(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each two aligned sequences of word hashes, the runs (start, stop) in which they are like enough and long enough."""
    many = np.array([min(len(x), len(y)) for x, y in zip(xs, ys)])
    begin = np.cumsum(many + 1) - many - 1
    # One unequal place ends each row, so that no run goes on in the next one.
    ends = begin + many
    size = int(ends[-1]) + 1
    equal = _joined([x[:n] for x, n in zip(xs, many)], begin, size, 0) == _joined([y[:n] for y, n in zip(ys, many)], begin, size, 1)
    equal[ends] = False
    before = np.concatenate([[0], np.cumsum(equal)])  # equal places before a place
    # A gap of GAP words follows SHINGLE equal ones at least, as many follow it.
    starts, stops = _runs(~equal)
    short = (stops - starts <= GAP) & (starts >= SHINGLE) & (stops + SHINGLE <= size)
    starts, stops = starts[short], stops[short]
    rows = np.searchsorted(begin, starts, side="right") - 1
    short = (stops <= ends[rows]) & (before[starts] - before[starts - SHINGLE] == SHINGLE) & (before[stops + SHINGLE] - before[stops] == SHINGLE)
    bridged = equal.copy()
    for gap in range(GAP):
        wide = short & (stops - starts > gap)
        bridged[starts[wide] + gap] = True
    starts, stops = _runs(bridged)
    long_ = stops - starts >= LEAST_WORDS
    starts, stops = starts[long_], stops[long_]
    rows = np.searchsorted(begin, starts, side="right") - 1
    whole = before[stops] - before[starts] == stops - starts
    out: list[list[tuple[int, int]]] = [[] for _ in xs]
    for k, at, a, b, same in zip(rows.tolist(), begin[rows].tolist(), starts.tolist(), stops.tolist(), whole.tolist()):
        if same or _likeness(xs[k][a - at : b - at], ys[k][a - at : b - at]) >= LEAST_LIKENESS:
            out[k].append((a - at, b - at))
        else:
            out[k] += [(a - at + c, a - at + d) for c, d in zip(*(e.tolist() for e in _runs(equal[a:b]))) if d - c >= LEAST_WORDS]
    return out


def _segments(owns: list[np.ndarray], others: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each two sequences of shingles (start, stop, distance), in words, of their equal runs of distances within BAND, in order.

    They are found diagonal by diagonal, for all rows at once: memory is bounded however often a shingle is repeated.
    """
    wide = np.array([max(len(x), len(y)) + BAND for x, y in zip(owns, others)])
    begin = BAND + np.cumsum(wide) - wide
    size = int(begin[-1] + wide[-1]) + BAND
    own, other = _joined(owns, begin, size, 1), _joined(others, begin, size, 2)
    line, runs = own[BAND : size - BAND], []
    for d in range(-BAND, BAND + 1):
        starts, stops = _runs(line == other[BAND + d : size - BAND + d])
        runs.append((starts, stops + SHINGLE - 1, np.full(len(starts), d)))
    first, last, d = (np.concatenate(c) for c in zip(*runs))
    order = np.lexsort((d, last, first))
    d, first, last = d[order], first[order] + BAND, last[order] + BAND
    rows = np.searchsorted(begin, first, side="right") - 1
    found = list(zip((first - begin[rows]).tolist(), (last - begin[rows]).tolist(), d.tolist()))
    cuts = np.searchsorted(rows, np.arange(len(owns) + 1)).tolist()
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of segments in order, the chain with the most words that is in order in both sequences."""
    if len(found) < 2:
        return found
    best: list[tuple[int, int]] = []  # words of the best chain that ends here, the one before it
    ranked: list[tuple[int, int]] = []  # the same chains, most words first, of equal ones the last: (-words, -segment)
    for k, (a, b, e) in enumerate(found):
        size = score = b - a
        before = -1
        for low, j in ranked:
            if size - low < score or size - low == score and before < 0:
                break
            p, q, f = found[-j]
            if p < a and p + f < a + e:
                # Of runs that overlap in x or y, as at a repeated word, the later one is shortened.
                over = max(0, q - a, q + f - a - e)
                value = size - low - over
                if over < size and (value > score or value == score and -j > before >= 0):
                    score, before = value, -j
        best.append((score, before))
        insort(ranked, (-score, -k))
    chain, k = [], max(range(len(found)), key=lambda j: best[j][0])
    while k >= 0:
        chain.append(found[k])
        k = best[k][1]
    return chain[::-1]


def aligned_passages(segments: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (start, stop, start in y, stop in y) that are like enough and long enough, with words inserted, deleted or replaced.

    Likeness is that of their aligned shingles: those equal in order, over those of either span.
    """
    if sum(b - a - SHINGLE + 1 for a, b, _ in segments) < LEAST_SAME:
        return []
    chain = _chain(segments)
    many = list(accumulate((b - a - SHINGLE + 1 for a, b, _ in chain), initial=0))
    out = []

    def take(low: int, high: int) -> None:
        longest = (0, 0, 0)
        for i in range(low, high):
            if many[high] - many[i] < LEAST_SAME:
                break
            a, _, d = chain[i]
            for j in range(high - 1, i - 1, -1):
                _, b, e = chain[j]
                one, two, same = b - a, b + e - a - d, many[j + 1] - many[i]
                if one <= longest[0] or same < LEAST_SAME:
                    break
                if one >= LEAST_WORDS and two >= LEAST_WORDS and same >= LEAST_LIKENESS * (one + two - 2 * SHINGLE + 2 - same) - 1e-9:
                    longest = (one, i, j)
                    break
        if longest[0]:
            _, i, j = longest
            (a, _, d), (_, b, e) = chain[i], chain[j]
            out.append((a, b, a + d, b + e))
            take(low, i)
            take(j + 1, high)

    take(0, len(chain))
    return out


def _rows_of_shingles(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all rows one after the other, where each row begins); no row has less than SHINGLE words."""
    sizes = [len(p) for p in parts]
    keys, _, _ = shingles(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), SHINGLE)
    return keys, np.cumsum([0, *(n - SHINGLE + 1 for n in sizes)])


def shared_in_pairs(xs: list[np.ndarray], ys: list[np.ndarray], lags: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each pair, the passages (start, stop, start in y, stop in y) of two sequences of word hashes of which y[0] stands ``lag`` words
    after x[0]'s place. All pairs are compared at once, so hand over some ten thousand words."""
    skip, drop = [max(0, n) for n in lags], [max(0, -n) for n in lags]
    xs, ys = [x[n:] for x, n in zip(xs, skip)], [y[n:] for y, n in zip(ys, drop)]
    found = [[(a, b, a, b) for a, b in f] for f in common_passages(xs, ys)]
    open_ = [k for k, (x, y) in enumerate(zip(xs, ys)) if min(len(x), len(y)) >= LEAST_WORDS and (x.size != y.size or found[k] != [(0, len(x), 0, len(y))])]
    if open_:
        own, begin = _rows_of_shingles([xs[k] for k in open_])
        other, there = _rows_of_shingles([ys[k] for k in open_])
        salt = mix(np.arange(1, len(open_) + 1, dtype=np.uint64))  # so that only shingles of one pair are equal
        ranked = np.sort(other ^ np.repeat(salt, np.diff(there)))
        asked = own ^ np.repeat(salt, np.diff(begin))
        both = ranked[np.minimum(np.searchsorted(ranked, asked), len(ranked) - 1)] == asked
        enough = np.add.reduceat(both, begin[:-1], dtype=np.int64) >= LEAST_LIKENESS * (LEAST_WORDS - SHINGLE + 1)
        for k, at, stop in zip(open_, begin[:-1].tolist(), begin[1:].tolist()):
            for a, b, _, _ in found[k]:
                both[at + max(0, a - SHINGLE + 1) : min(at + b, stop)] = False
        # Common shingles outside of what was found at one distance make a passage or lengthen one; two passages may be one.
        enough &= np.logical_or.reduceat(both, begin[:-1]) | np.array([len(found[k]) > 1 for k in open_])
        rows = np.flatnonzero(enough).tolist()
        if rows:
            of = _segments([own[begin[r] : begin[r + 1]] for r in rows], [other[there[r] : there[r + 1]] for r in rows])
            for r, segments in zip(rows, of):
                k, more = open_[r], aligned_passages(segments)
                found[k] = [f for f in found[k] if not any(a <= f[0] and f[1] <= b for a, b, _, _ in more)] + more
    return [[(m + a, m + b, n + c, n + d) for a, b, c, d in f] for f, m, n in zip(found, skip, drop)]


def shared_passages(x: np.ndarray, y: np.ndarray, lag: int = 0) -> list[tuple[int, int, int, int]]:
    """Passages (start, stop, start in y, stop in y) of two sequences of word hashes of which y[0] stands ``lag`` words after x[0]'s place."""
    return shared_in_pairs([x], [y], [lag])[0]


def _confirmed(chains: DataFrame) -> DataFrame:
    """What chains with both stretches (x, y) of word hashes hold: passages, and longer runs that the other document has not.

    A passage is (id, th, first, stop, other, other_th, other_first, other_stop). A longer run is (id, th, first) and its hash in ``key``: one
    of the chain's equal runs with MORE words before or after it that are not those of the other document.
    """
    kind = chains.schema["id"].dataType.simpleString()
    names = ["id", "th", "first", "stop", "other", "other_th", "other_first", "other_stop", "key"]

    def run(batches):
        for batch in batches:
            rows, spans = [], []
            own, other = (np.maximum(0, batch.column(c).to_numpy()) for c in (6, 7))
            ahead = other + batch.column(8).to_numpy() - own
            runs, twins = batch.column(9).to_pylist(), batch.column(10).to_pylist()
            todo: list[tuple[int, np.ndarray, np.ndarray]] = []
            held = 0

            def compare():
                for (k, _, _), found in zip(todo, shared_in_pairs([x for _, x, _ in todo], [y for _, _, y in todo], [int(ahead[k]) for k, _, _ in todo])):
                    for a, b, c, d in found:
                        rows.append(k)
                        spans.append((int(own[k]) + a, int(own[k]) + b, int(other[k]) + c, int(other[k]) + d, None))
                todo.clear()

            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                start, there = int(own[k]), int(other[k])
                if runs[k]:
                    longer = longer_runs(x.as_py(), y.as_py(), [((r >> 32) - start, (r & 0xFFFFFFFF) - there) for r in runs[k]])
                    rows += [k] * len(longer)
                    spans += [(start + first, None, None, None, key - (key >> 63 << 64)) for first, key in longer]
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                if min(len(x), len(y)) >= LEAST_WORDS and not twins[k]:
                    if todo and held + len(x) + len(y) > PAIR_WORDS:
                        compare()
                        held = 0
                    todo.append((k, x, y))
                    held += len(x) + len(y)
            if todo:
                compare()
            if rows:
                at = pa.array(rows)
                first, stop, there, end, key = (pa.array(c, pa.int64()) for c in zip(*spans))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), first, stop, batch.column(2).take(at), batch.column(3).take(at), there, end, key], names)

    twin = F.expr("id = other and th = other_th")
    rows = chains.select("id", "th", "other", "other_th", "x", "y", "lo", "other_lo", "distance", "runs", twin)
    return rows.mapInArrow(run, f"id {kind}, th int, first long, stop long, other {kind}, other_th int, other_first long, other_stop long, key long")


def _heads(found: DataFrame, unique: bool) -> DataFrame:
    """(key, n, head) of the keys of several occurrences: their number and the first one (id, th, at).

    Where no two texts have one id (``unique``), buffers are numbers, so that Spark aggregates by hash; else it sorts all occurrences.
    """
    if not unique:
        return found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("head")).where("n > 1")
    place = F.shiftleft(F.col("th").cast("long"), 32) + F.col("at")
    heads = found.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min_by(place, F.when(F.col("first"), F.col("id"))).alias("place")).where("n > 1")
    th, at = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int")
    return heads.select("key", "n", F.struct("id", th.alias("th"), at.alias("at")).alias("head"))


def _compared(texts: DataFrame, found: DataFrame, few: bool, unique: bool = False) -> DataFrame:
    """What comes of comparing the occurrences (id, th, at, key) of each key with the first one; see _confirmed.

    With ``few``, occurrences are longer runs, which few texts hold: no other text is shuffled. Else they are a staged table, which is deleted
    as soon as chains are written.
    """
    heads = staged(_heads(found, unique), "heads")
    # One row for each key is the smaller side, and the other one needs no sorting.
    own = join_heavy(found, heads.hint("shuffle_hash"), "key", "n").select("id", "th", "at", (F.col("key").bitwiseAND(1) == 1).alias("run"), F.col("head.id").alias("other"), F.col("head.th").alias("other_th"), F.col("head.at").alias("other_at"))
    twin = "id = other and th = other_th"
    # A run's other places in its first document may be longer runs; passages within a document stay.
    own = own.where(f"not ({twin})" if few else f"not ({twin}) or run and at <> other_at")
    lane = F.floor((F.col("at") - F.col("other_at")) / LANE)
    size = EQUAL + MORE if few else EQUAL
    ends = lambda at: [F.min(at).cast("long") - REACH, F.max(at).cast("long") + size + REACH]
    spans = [e.alias(n) for e, n in zip([*ends("at"), *ends("other_at")], ["lo", "hi", "other_lo", "other_hi"])]
    # Both places of a run in one number.
    places = F.shiftleft(F.col("at").cast("long"), 32) + F.col("other_at")
    spans.append(F.collect_list(F.when(F.col("run") & ~F.lit(few), places)).alias("runs"))
    chains = own.groupBy("id", "th", "other", "other_th", lane.alias("lane")).agg(F.mode(F.col("at") - F.col("other_at"), deterministic=True).cast("long").alias("distance"), *spans)
    chains = staged(chains.drop("lane"), "chains")
    discard(heads, *([] if few else [found]))
    there = ["other", "other_th", "other_lo", "other_hi"]
    wanted = chains.select("id", "th", "lo", "hi").unionByName(chains.select(*(F.col(c).alias(c.removeprefix("other_") if c != "other" else "id") for c in there)))
    read = staged(_stretches(rows_with(texts, ["id", "th"], wanted) if few else texts, wanted), "stretches")
    both = chains.join(read.withColumnRenamed("hashes", "x"), ["id", "th", "lo", "hi"])
    both = both.join(read.toDF(*there, "y"), there)
    out = staged(_confirmed(both), "compared")
    discard(chains, read)
    return out


def repeated_passages(texts: DataFrame, unique: bool = False) -> DataFrame:
    """(id, th, first, stop, other, other_th, other_first, other_stop): passages, in words, that a document shares with the first that has a key.

    The first document with an equal run may hold it in other surroundings. Such runs with more words on either side are keys of a second
    round: documents that share LEAST_EQUAL words share one of these keys, or both share it with the first document; and what shares one
    shares EQUAL + MORE words, which are a passage. So no link by as many equal words is lost. ``unique``: no two texts have one id.
    """
    found = staged(_anchor_rows(texts.where("id is not null")), "anchors")
    first = _compared(texts, found, few=False, unique=unique)
    passages = ["id", "th", "first", "stop", "other", "other_th", "other_first", "other_stop"]
    out = first.where("key is null").select(*passages)
    longer = first.where("key is not null").select("id", "th", F.col("first").cast("int").alias("at"), "key")
    return out.unionByName(_compared(texts, longer, few=True).select(*passages))


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, further kept columns, n_bytes, n_removed, n_spans, n_repeated, component_id, kept string) of every row.

    ``n_repeated`` counts the bytes in passages shared with another document, ``n_removed`` those of them that an earlier document has;
    documents are ordered by id. ``kept`` is the text without the removed passages, other bytes unchanged. ``component_id`` is the least
    id that shared passages reach, the row's own included. A null text counts as empty; a row with a null id is left as it is. Rows with
    one id and different texts are different documents; equal rows are one. Repeats within a document stay. Extra columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    keep = keep or []
    extra = [f"_kept{k}" for k in range(len(keep))]
    rows_in = texts_of(df, df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *(df[c].alias(n) for c, n in zip(keep, extra))).withColumn("th", F.hash("text"))
    texts = rows_in.select("id", "th", "text")
    repeats = _repeats(texts)
    found = staged(repeated_passages(texts.dropDuplicates(["id", "th"]) if repeats else texts, unique=not repeats), "passages")
    linked = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    lost = found.select("id", "th", F.lit(True).alias("lost"), "first", "stop")
    shared = found.select(F.col("other").alias("id"), F.col("other_th").alias("th"), F.lit(False).alias("lost"), F.col("other_first").alias("first"), F.col("other_stop").alias("stop")).distinct()
    by_text = lost.unionByName(shared).groupBy("id", "th").agg(F.collect_list(F.struct("lost", "first", "stop")).alias("spans"))
    by_text = by_text.join(linked, "id", "left")
    joined = rows_in.join(by_text, ["id", "th"], "left").select("id", "text", "spans", F.coalesce("component", "id").alias("component"), *extra)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [cut(text.as_py(), spans.as_py()) for text, spans in zip(part.column(1), part.column(2))]
                n, removed, many, shared_, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(part.column(4 + k) for k in range(len(extra))), *(pa.array(c, pa.int64()) for c in (n, removed, many, shared_)), part.column(3), pa.array(kept, pa.string())],
                    ["id", *extra, "n_bytes", "n_removed", "n_spans", "n_repeated", "component_id", "kept"],
                )

    more = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for c, n in zip(keep, extra))
    out = joined.mapInArrow(run, f"id {kind}, {more}n_bytes long, n_removed long, n_spans long, n_repeated long, component_id {kind}, kept string")
    return out.withColumnsRenamed({"id": id_col, **dict(zip(extra, keep))})


def _repeats(texts: DataFrame) -> bool:
    return not texts.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def cut(text: str, spans: list[dict] | None) -> tuple[int, int, int, int, str]:
    """(bytes, removed bytes, removed runs, bytes in shared passages, what is kept) of a text, with spans in words."""
    raw = text.encode()
    if not spans:
        return len(raw), 0, 0, 0, text
    data = np.frombuffer(raw, np.uint8)
    starts = np.append(words(data, np.array([0, len(data)]))[0], len(data))
    marks = np.zeros((2, len(starts) + 1), dtype=np.int64)
    for s in spans:
        first, stop = min(s["first"], len(starts) - 1), min(s["stop"], len(starts) - 1)
        marks[:, first] += (1, s["lost"])
        marks[:, stop] -= (1, s["lost"])
    shared, lost = np.cumsum(marks, axis=1)[:, : len(starts)] > 0
    size = np.diff(np.append(starts, len(data)))
    begin, end = _runs(lost)
    begin, end = starts[begin].tolist(), starts[np.minimum(end, len(starts) - 1)].tolist()
    kept = b"".join([raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)])])
    return len(raw), len(raw) - len(kept), len(begin), int(size[shared].sum()), kept.decode()
