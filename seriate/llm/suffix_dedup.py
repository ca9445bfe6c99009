"""Operator 2: removal of repeated byte strings by suffix sorting, deep and shallow.

Sorting every suffix of a corpus moves each byte hundreds of times, so suffixes are sorted only where a repeat is possible. Each window of
the wanted length picks the place of its least 32-byte hash; equal windows pick equal places. Windows that share a place make a segment,
keyed by the bytes there. Keys that occur once cannot repeat. Where all segments of a key are equal, all their windows repeat. The
others are sorted key by key: what stands right of the place and, reversed, left of it, by multikey quicksort down to a shallow depth
and by blind tries below it. Two windows are equal if both their halves have the same place in those orders.

Keys with very many different segments are not gathered. Their windows are dealt anew by where the place stands in them, in ever
narrower ranges, and each range is keyed by the bytes that all its windows have; at last a range is a single window.

What texts share with other texts is found first, at a smaller width. A text can repeat a string of the wanted length only where windows of
the smaller one, all with keys that occur twice, stand side by side for that long; only such texts are looked at again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, rows_with, staged, text_slices, texts_of

#: Bytes whose hash decides a window's place; bytes that quicksort looks at before tries take over.
GRAM, SHALLOW = 32, 24
#: A key with more different segments than this is split, by ranges of so many places each, one after the other.
MOST_SEGMENTS, RANGES = 1000, (64, 8, 1)
#: Segments up to this number are compared by pairs of neighbours' prefixes, more by classes for each place in the window.
PAIRWISE = 24


# -- deep-shallow sorting -----------------------------------------------------------------------------------------------------------


def common_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """How long the common prefix is, given that it is at least ``start``."""
    n = min(len(x), len(y))
    step = 64
    while start < n:
        if x[start : start + step] == y[start : start + step]:
            start += step
            continue
        if step == 1:
            return start
        step >>= 2
        step = step or 1
    return n


class BlindTrie:
    """A trie of strings that share a prefix; inner nodes hold a depth and the branches' bytes, skipped bytes are not looked at."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None

    def insert(self, k: int) -> None:
        own, strings = self.strings[k], self.strings
        if self.root is None:
            self.root = [None, {}, [k]]
            return
        node = self.root
        # Blind descent: any leaf will do once a branch is missing.
        while node[0] is not None:
            byte = own[node[0]] if node[0] < len(own) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        leaf = strings[node[2][0]]
        depth = common_prefix(own, leaf)
        if depth == len(own) == len(leaf):
            node[2].append(k)
            return
        # Second descent, to the node below which the string differs.
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][own[node[0]]]
        new = [None, {}, [k]]
        mine, theirs = own[depth] if depth < len(own) else -1, leaf[depth] if depth < len(leaf) else -1
        if node[0] == depth:
            node[1][mine] = new
            return
        old = node[:]
        node[0], node[1], node[2] = depth, {theirs: old, mine: new}, []

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of strings: three-way quicksort byte by byte to the shallow depth, blind tries for groups that are equal so far."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            out += trie.order()
        else:
            heads = [strings[k][depth] if depth < len(strings[k]) else -1 for k in group]
            pivot = sorted((heads[0], heads[len(heads) // 2], heads[-1]))[1]
            less = [k for k, h in zip(group, heads) if h < pivot]
            same = [k for k, h in zip(group, heads) if h == pivot]
            more = [k for k, h in zip(group, heads) if h > pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:
                if less:
                    stack.append((less, depth))
                out_of = same  # strings that end here are equal
                stack.append((out_of, shallow)) if len(out_of) > 1 else stack.append((out_of, depth))
            else:
                stack.append((same, depth + 1))
                if less:
                    stack.append((less, depth))
    return out


def sorted_prefixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings and the common prefix of each with the one before it (0 for the first)."""
    order = deep_shallow(strings)
    return order, [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def repeated_windows(segments: list[bytes], offsets: list[int], weights: list[int], width: int, owners: list[int] | None = None) -> list[np.ndarray]:
    """For different segments of one key, which windows (by their start) occur twice or more.

    ``offsets`` are the places of the key in the segments, ``weights`` how often each segment occurs. With ``owners``, segments of weight 1
    and one owner do not repeat each other.
    """
    m = len(segments)
    runs = [len(s) - width + 1 for s in segments]
    flags = [np.full(r, w > 1) for r, w in zip(runs, weights)]
    right, up = sorted_prefixes([s[o:] for s, o in zip(segments, offsets)])
    left, down = sorted_prefixes([s[:o][::-1] for s, o in zip(segments, offsets)])
    if m <= PAIRWISE:
        reach = np.zeros((2, m, m), dtype=np.int64)
        for side, (order, prefix) in enumerate(((right, up), (left, down))):
            for i in range(m):
                low = 1 << 30
                for j in range(i + 1, m):
                    low = min(low, prefix[j])
                    if not low:
                        break
                    reach[side, order[i], order[j]] = reach[side, order[j], order[i]] = low
        for i in range(m):
            for j in range(m):
                if i != j and (owners is None or owners[i] != owners[j] or weights[j] > 1):
                    first, stop = offsets[i] - int(reach[1, i, j]), offsets[i] - width + int(reach[0, i, j]) + 1
                    if first < stop:
                        flags[i][max(0, first) : max(0, stop)] = True
        return flags
    place = np.array(offsets)
    low, high = place - np.array(runs) + 1, place
    own_by = np.arange(m) if owners is None else np.unique(owners, return_inverse=True)[1]
    alone = np.where(np.array(weights) > 1, m, own_by)  # m: more owners than one
    right, left, up, down = map(np.array, (right, left, up, down))
    for d in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= d) & (d <= high))
        if len(own) < 2:
            continue
        # Members between which no neighbours' prefix is shorter are equal to that depth.
        one, two = np.empty(m, np.int64), np.empty(m, np.int64)
        one[right], two[left] = np.cumsum(up < width - d), np.cumsum(down < d)
        both = one[own] * (m + 1) + two[own]
        _, which = np.unique(both, return_inverse=True)
        least, most = np.full(len(own), m), np.full(len(own), -1)
        np.minimum.at(least, which, alone[own])
        np.maximum.at(most, which, alone[own])
        for k in own[(least != most)[which]].tolist():
            flags[k][place[k] - d] = True
    return flags


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def merged(first: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and stops of the union of spans; spans that touch are one."""
    if not len(first):
        return [], []
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    cut = np.flatnonzero(first[1:] > stop[:-1])
    return first[np.append(0, cut + 1)].tolist(), stop[np.append(cut, len(stop) - 1)].tolist()


# -- segments ------------------------------------------------------------------------------------------------------------------------


def segments_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, key, first window, windows, place of the key in the first window) of every segment of the rows."""
    n, grams = len(data), width - GRAM + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < width:
        return none
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,)).copy()
    size = n - GRAM + 1
    with np.errstate(over="ignore"):
        hashes = mix(eight[:size] * np.uint64(0x9E3779B97F4A7C15) + eight[8 : size + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[16 : size + 16] * np.uint64(0x165667B19E3779F9) + eight[24 : size + 24] * np.uint64(0xD6E8FEB86659FD93))
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = (hashes & ~mask) | np.arange(size, dtype=np.uint64)
    step = 1
    while 2 * step <= grams:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if grams > step:
        low = np.minimum(low[: len(low) - (grams - step)], low[grams - step :])
    place = (low & mask).astype(np.int64)  # by window start
    row = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1 if len(offsets) > 2 else np.zeros(len(place), np.int64)
    if len(offsets) > 2:
        good = np.arange(len(place)) + width <= offsets[row + 1]
    else:
        good = np.ones(len(place), bool)
    starts = np.flatnonzero(good)
    if not len(starts):
        return none
    place, row = place[starts], row[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    windows = np.diff(np.append(first, len(starts)))
    return row[first], hashes[place[first]].view(np.int64), starts[first], windows, place[first] - starts[first]


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start << 24 | windows << 12 | offset


def segments(texts: DataFrame, width: int) -> DataFrame:
    """(id, th, key, content, at) of every segment; ``content`` is a 64-bit digest, ``at`` packs start, windows and offset."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                row, key, start, windows, offset = segments_of(data, offsets, width)
                if not len(row):
                    continue
                view = memoryview(np.ascontiguousarray(data))
                digest = hashlib.blake2b
                content = np.frombuffer(b"".join([digest(view[s : s + w + width - 1], digest_size=8).digest() for s, w in zip(start.tolist(), windows.tolist())]), dtype="<i8")
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key), pa.array(content), pa.array(_pack(start - offsets[row], windows, offset))], ["id", "th", "key", "content", "at"])

    return texts.select("id", "th", "text").mapInArrow(run, f"id {kind}, th int, key long, content long, at long")


def _contents(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, content, at, n, m, owner, bytes) of the wanted segments (those and id, th), each read from one text that has it."""
    by_text = staged(wanted.groupBy("id", "th").agg(F.collect_list(F.struct("key", "content", "at", "n", "m", "owner")).alias("own")), "segment-texts")
    texts = rows_with(texts, ["id", "th"], by_text)

    def run(batches):
        for batch in batches:
            names = ["key", "content", "at", "n", "m", "owner"]
            for k in range(batch.num_rows):
                text, own = (batch.column(0)[k].as_py() or "").encode(), batch.column(1)[k].values
                at = own.field("at").to_numpy()
                start, windows = at >> 24, at >> 12 & 4095
                data = [text[s : s + w + width - 1] for s, w in zip(start.tolist(), windows.tolist())]
                yield pa.RecordBatch.from_arrays([*(own.field(c) for c in names), pa.array(data, pa.binary())], [*names, "bytes"])

    same = texts["id"].eqNullSafe(by_text["id"]) & (texts["th"] == by_text["th"])
    joined = texts.join(by_text, same).select("text", "own")
    out = staged(joined.mapInArrow(run, "key long, content long, at long, n long, m long, owner long, bytes binary"), "segment-bytes")
    discard(by_text)
    return out


def _sorted_groups(rows: DataFrame, width: int) -> DataFrame:
    """(key, content, first, stop) of the repeated window runs of segments, one key at a time within sorted partitions."""

    def emit(group: dict) -> list[tuple]:
        key, own = group["key"], list(group["own"].items())
        flags = repeated_windows([x[1][2] for x in own], [x[1][1] for x in own], [x[1][0] for x in own], width, [x[1][3] for x in own])
        return [(key, content, int(a), int(b)) for (content, _), f in zip(own, flags) for a, b in zip(*spans(f))]

    def run(batches):
        group: dict = {}
        found: list[tuple] = []
        for batch in batches:
            at = batch.column(2).to_numpy()
            for key, content, offset, n, data, owner in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (at & 4095).tolist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
                if group.get("key") != key:
                    if group:
                        found += emit(group)
                    group = {"key": key, "own": {}}
                group["own"][content] = (n, offset, data.as_py(), owner)
            if len(found) > 20_000:
                yield _spans_batch(found)
                found = []
        if group:
            found += emit(group)
        if found:
            yield _spans_batch(found)

    sorted_ = rows.select("key", "content", "at", "n", "bytes", "owner").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(run, "key long, content long, first long, stop long")


def _spans_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["key", "content", "first", "stop"])


def _split(rows: DataFrame, width: int, step: int) -> DataFrame:
    """Cut segments into parts whose windows have the place within one range of ``step`` bytes.

    A part's key covers the bytes that all windows of its range have, whatever windows the segment itself has of it.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                root_key, root_content, base, key, off, n, owner, data = (batch.column(c)[k].as_py() for c in range(8))
                low, high = off - (len(data) - width), off  # where the place stands in the windows
                for part in range(low // step, high // step + 1):
                    d1, d2 = part * step, min(part * step + step, width) - 1
                    first, stop = off - min(high, d2), off - max(low, d1) + 1
                    own, core = data[first : stop - 1 + width], data[off - d1 : off + width - d2] if d1 <= off else data[:0]
                    digest = hashlib.blake2b(core, digest_size=8, person=f"{key & 0xFFFFFFFF:x}.{part:x}"[:16].encode()).digest()
                    content = hashlib.blake2b(own, digest_size=8).digest()
                    out.append((root_key, root_content, base + first, int.from_bytes(digest, "little", signed=True), int.from_bytes(content, "little", signed=True), off - first, n, owner, own))
            if out:
                names = ["root_key", "root_content", "base", "key", "content", "at", "n", "owner", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "bytes" else pa.int64()) for c, name in zip(zip(*out), names)], names)

    return rows.select("root_key", "root_content", "base", "key", "at", "n", "owner", "bytes").mapInArrow(run, "root_key long, root_content long, base long, key long, content long, at long, n long, owner long, bytes binary")


def _more() -> Column:
    """2 if a group of segments has several owners or one of weight above 1, else 1."""
    return F.when((F.max("n") > 1) | (F.min("owner") != F.max("owner")), 2).otherwise(1).cast("long")


def _large_groups(rows: DataFrame, width: int, most_segments: int) -> DataFrame:
    """The same for keys with too many segments to gather, by parts of them."""
    now = rows.dropDuplicates(["key", "content"]).select(F.col("key").alias("root_key"), F.col("content").alias("root_content"), F.lit(0).cast("long").alias("base"), "key", F.col("at").bitwiseAND(F.lit(4095)).alias("at"), "n", "owner", "bytes")
    out = None
    for step in RANGES:
        parts = staged(_split(now, width, step), "parts")
        classes = parts.groupBy("key", "content").agg(_more().alias("n"), F.min("owner").alias("owner"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
        classes = staged(classes, "part-classes")
        sizes = classes.groupBy("key").agg(F.count("*").alias("m"), _more().alias("n")).where("n > 1").select("key", "m")
        classes = staged(classes.join(sizes, "key"), "part-sizes")
        runs = _sorted_groups(classes.where(F.col("m") <= most_segments), width)
        found = parts.join(runs, ["key", "content"]).select(F.col("root_key").alias("key"), F.col("root_content").alias("content"), (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("stop")).alias("stop"))
        out = found if out is None else out.unionByName(found)
        large = classes.where(F.col("m") > most_segments)
        if large.isEmpty():
            break
        now = parts.join(large.select("key", "content"), ["key", "content"], "left_semi")
    return out


def keyed_segments(texts: DataFrame, width: int) -> DataFrame:
    """Segments whose key occurs twice or more; ``several``: with different contents, ``apart``: in different texts."""
    found = staged(segments(texts, width), "segments")
    owner = F.xxhash64("id", "th")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.min(owner).alias("one"), F.max(owner).alias("other")).where("n > 1")
    keyed = staged(found.join(keys.select("key", (F.col("lo") != F.col("hi")).alias("several"), (F.col("one") != F.col("other")).alias("apart")), "key"), "keyed")
    discard(found)
    return keyed


def repeated_spans(texts: DataFrame, keyed: DataFrame, width: int, most_segments: int = MOST_SEGMENTS, across: bool = False) -> DataFrame:
    """(id, th, first, stop): byte spans of texts (id, th, text) that strings occurring twice or more cover, not yet merged.

    With ``across``, strings that occur in two texts or more; rows of equal id and text count as one text.
    """
    start, windows = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    wanted = keyed.where("apart") if across else keyed
    whole = wanted.where("not several").select("id", "th", start.alias("first"), (start + windows - 1 + width).alias("stop"))
    several = wanted.where("several")
    text = F.xxhash64("id", "th")
    n, owner = (F.when(F.min(text) != F.max(text), 2).otherwise(1).cast("long"), F.min(text)) if across else (F.count("*"), F.first("content"))
    classes = several.groupBy("key", "content").agg(n.alias("n"), owner.alias("owner"), F.min(F.struct("id", "th", "at")).alias("one"))
    sizes = staged(classes, "segment-classes")
    classes = sizes.join(sizes.groupBy("key").agg(F.count("*").alias("m")), "key").select("one.*", "key", "content", "n", "m", "owner")
    rows = _contents(texts, classes, width)
    discard(sizes)
    runs = _sorted_groups(rows.where(F.col("m") <= most_segments), width).unionByName(_large_groups(rows.where(F.col("m") > most_segments), width, most_segments))
    parts = several.join(runs, ["key", "content"]).select("id", "th", (start + F.col("first")).alias("first"), (start + F.col("stop") - 1 + width).alias("stop"))
    out = staged(whole.unionByName(parts), "spans")
    discard(rows)
    return out


def texts_with_runs(keyed: DataFrame, windows: int) -> DataFrame:
    """(id, th) of the texts in which so many windows, all of keyed segments, stand side by side."""
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own = batch.column(2)
            at, sizes = own.flatten().to_numpy(), own.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            first = row << 40 | at >> 24
            order = np.argsort(first, kind="stable")
            first, stop = first[order], np.maximum.accumulate(first[order] + (at[order] >> 12 & 4095))
            fresh = np.flatnonzero(np.append(True, first[1:] > stop[:-1]))
            long_ = stop[np.append(fresh[1:], len(stop)) - 1] - first[fresh] >= windows
            rows = pa.array(np.unique(first[fresh][long_] >> 40))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["id", "th"])

    return keyed.groupBy("id", "th").agg(F.collect_list("at").alias("at")).mapInArrow(run, f"id {kind}, th int")


def remove_repeats(df: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", most_segments: int = MOST_SEGMENTS, shared_width: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, n_shared) of every row.

    Each byte covered by a string of ``width`` bytes that also starts anywhere else, in this text or another, is removed; strings are
    judged on the input. A null text counts as empty; texts below the width keep everything. Of rows that repeat an id each is judged by
    its own text; equal rows repeat each other. ``n_shared`` counts the bytes, removed or not, covered by strings of ``shared_width`` bytes
    (at most ``width``, 256 if not given) that also stand in another text; equal rows are one text there. Extra columns are ignored.
    """
    shared_width = min(256, width) if shared_width is None else shared_width
    if not GRAM <= shared_width <= width <= 4000:
        raise ValueError(f"widths must be between {GRAM} and 4000 bytes, that of shared strings at most the other")
    kind = df.schema[id_col].dataType.simpleString()
    texts = texts_of(df, df[id_col].alias("id"), F.hash(F.coalesce(df[text_col], F.lit(""))).alias("th"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    keyed = keyed_segments(texts, shared_width)
    shared = repeated_spans(texts, keyed, shared_width, most_segments, across=True)
    again = staged(texts_with_runs(keyed, width - shared_width + 1), "again")
    discard(keyed)
    some = rows_with(texts, ["id", "th"], again)
    some = staged(some.join(again, some["id"].eqNullSafe(again["id"]) & (some["th"] == again["th"]), "left_semi"), "texts-again")
    keyed = keyed_segments(some, width)
    found = repeated_spans(some, keyed, width, most_segments)
    discard(keyed, some, again)
    span = F.struct("first", "stop", "gone")
    both = found.withColumn("gone", F.lit(True)).unionByName(shared.withColumn("gone", F.lit(False)))
    by_text = both.groupBy("id", "th").agg(F.collect_list(span).alias("spans"))
    joined = texts.join(by_text, (texts["id"].eqNullSafe(by_text["id"])) & (texts["th"] == by_text["th"]), "left").select(texts["id"], "text", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, own in zip(part.column(1).to_pylist(), part.column(2)):
                    raw = text.encode()
                    if not own.is_valid or not len(own.values):
                        rows.append((len(raw), 0, 0, raw, 0))
                        continue
                    first, stop, gone = (own.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "stop", "gone"))
                    begin, end = merged(first[gone], stop[gone])
                    kept = b"".join([raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)])])
                    low, high = merged(first[~gone], stop[~gone])
                    rows.append((len(raw), len(raw) - len(kept), len(begin), kept, sum(high) - sum(low)))
                n, removed, many, kept, shared_ = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, many)), pa.array(kept, pa.binary()), pa.array(shared_, pa.int64())], ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"])

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long").withColumnRenamed("id", id_col)
