"""Operator 9: best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (one number for each length up to the capacity) reaches the driver. The configuration program
over it (fewest sequences that cover every length's count) is solved by multiplicative weights: each length's weight falls as it is
covered, a knapsack dynamic program over the capacity prices the best configurations, and these are raised. The weights are a dual
solution as well, whose bound says how far from the fewest a packing can be. Multiplicities are rounded down; copies that hold a length too
often give it up, and what is left goes to best fit, into their room first. The plan numbers the pieces of each length, and tasks place
each piece by its number; no piece passes through the driver.
"""

from __future__ import annotations

import array
import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, PairIndexBpe, groups_of
from .common import staged, texts_of

#: Characters that are encoded at once.
GROUP_CHARS = 1_000_000
#: A configuration: ((length, how many of it), ...) by falling length.
Config = tuple[tuple[int, int], ...]

#: Rounds of multiplicative weights at most, how fast weights move, how near to the dearest configuration others are raised with it, and the
#: share above the dual bound at which the program ends.
ROUNDS, SPEED, CLOSE, GAP = 512, 0.05, 0.02, 0.0005


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack by dynamic programming: the greatest value for each room, and the item (its index) that it took there, or -1."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = upto[room]
        worth = values[:n] + best[room - lengths[:n]]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], took[room] = worth[k], k
        else:
            best[room] = best[room - 1]
    return best, took


def configuration(first: int, took: np.ndarray, lengths: np.ndarray, capacity: int) -> Config:
    """The item ``first`` and the best that fits beside it."""
    size = int(lengths[first])
    found = {size: 1}
    room = capacity - size
    while room > 0:
        if took[room] < 0:
            room -= 1
            continue
        size = int(lengths[took[room]])
        found[size] = found.get(size, 0) + 1
        room -= size
    return tuple(sorted(found.items(), reverse=True))


def covering_program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Iterator[tuple[dict[Config, float], float]]:
    """The covering program by multiplicative weights: after rounds 32, 64, 128, ... (multiplicities of configurations, dual bound).

    A length's weight is its dual value times its count. A round prices every length's best configuration under these values, raises those
    within CLOSE of the dearest until a length is covered once, and lowers a length's weight by how far it was covered. The values over
    the dearest configuration's worth are a dual solution, so that no packing has fewer sequences than the bound. They start at the
    lengths' shares of the capacity. Multiplicities are the average of the rounds since the last yield but one, to the bound's size.
    """
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(float)
    place = {int(s): k for k, s in enumerate(lengths)}
    logs = np.log(lengths * n)
    bound = float(n @ lengths) / capacity
    whole: dict[Config, float] = {}
    last: dict[Config, float] = {}
    mark = 32
    for t in range(1, rounds + 1):
        values = np.exp(logs - logs.max()) / n
        best, took = price(values, lengths, capacity)
        bound = max(bound, float(n @ values) / best[capacity])
        near = np.flatnonzero(values + best[capacity - lengths] >= (1 - CLOSE) * best[capacity])
        covered = np.zeros(len(lengths))
        for config in sorted({configuration(int(k), took, lengths, capacity) for k in near}):
            own = [place[size] for size, _ in config]
            many = np.array([k for _, k in config])
            step = float(((1 - covered[own]) * n[own] / many).min())
            if step > 1e-9 * n.max():
                covered[own] += many * step / n[own]
                last[config] = last.get(config, 0.0) + step
        logs -= SPEED * covered
        if t == mark or t == rounds:
            for config, x in last.items():
                whole[config] = whole.get(config, 0.0) + x
            scale = bound / sum(whole.values())
            yield {config: x * scale for config, x in whole.items()}, bound
            whole, last, mark = last, {}, 2 * mark


def best_fit(counts: np.ndarray, capacity: int, bins: dict[int, dict[Config, int]] | None = None) -> dict[Config, int]:
    """Best fit by falling length, on counts: bins with the same content are one entry. ``bins``, by their room, are there already."""
    bins = {} if bins is None else bins

    def put(free: int, config: Config, n: int) -> None:
        if n:
            own = bins.setdefault(free, {})
            own[config] = own.get(config, 0) + n

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for free in sorted(f for f in bins if f >= size):
            while left and bins.get(free):
                config, n = bins[free].popitem()
                fit = min(free // size, left)  # best fit fills the same bin as long as it holds more
                full = min(n, left // fit)
                put(free, config, n - full)
                put(free - fit * size, (*config, (size, fit)), full)
                left -= full * fit
            if not left:
                break
        fit = capacity // size
        put(capacity - fit * size, ((size, fit),), left // fit)
        if left % fit:
            put(capacity - (left % fit) * size, ((size, left % fit),), 1)
    out: dict[Config, int] = {}
    for own in bins.values():
        for config, n in own.items():
            out[config] = out.get(config, 0) + n
    return out


def rounded(program: dict[Config, float], counts: np.ndarray, capacity: int) -> dict[Config, int]:
    """Whole multiplicities of configurations that hold exactly the counts.

    Those of the program are rounded down, the largest first. Copies for which a length has run out stay without it, with room; what no copy
    holds goes to best fit, into this room first.
    """
    rest = counts.astype(np.int64).copy()
    bins: dict[int, dict[Config, int]] = {}
    for config, x in sorted(program.items(), key=lambda c: (-c[1], c[0])):
        left = int(x + 1e-6)
        while left:
            config = tuple((size, min(k, int(rest[size]))) for size, k in config if rest[size])
            if not config:
                break
            n = min(left, *(int(rest[size]) // k for size, k in config))
            own = bins.setdefault(capacity - sum(size * k for size, k in config), {})
            own[config] = own.get(config, 0) + n
            for size, k in config:
                rest[size] -= k * n
            left -= n
    return best_fit(rest, capacity, bins)


def plan(counts: np.ndarray, capacity: int) -> dict[Config, int]:
    """The fewest sequences found for the counts: the best rounding of the covering program, or plain best fit should that have fewer.

    The program ends as soon as its rounding is within GAP of the dual bound (or is the bound's next whole number), at ROUNDS at the latest.
    """
    left = counts.astype(np.int64).copy()
    whole = {((capacity, 1),): int(left[capacity])} if left[capacity] else {}
    left[capacity] = 0
    if not left.any():
        return whole
    size = lambda configs: sum(configs.values())
    found: list[dict[Config, int]] = []
    for program, bound in covering_program(left, capacity):
        found.append(rounded(program, left, capacity))
        if size(found[-1]) <= max(np.ceil(bound - 1e-6), (1 + GAP) * bound):
            break
    return min(*found, best_fit(left, capacity), key=size) | whole


def slots(configs: dict[Config, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, offset), sorted: a piece's number finds the row at or before it."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for config, n in sorted(configs.items()):
        offset = 0
        for size, k in config:
            for _ in range(k):
                rows.append((size, used[size], base, offset))
                used[size] += n
                offset += size
        base += n
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _added_tokens(tokenizer: str) -> list[dict]:
    with open(tokenizer, encoding="utf-8") as f:
        return json.load(f).get("added_tokens", [])


class _Ranks(PairIndexBpe):
    """The same vocabulary with a library's merges for unseen parts; ids equal those of the file's own merges, which are not kept here."""

    caches = 1

    def __init__(self, specials: list[dict] | str, ranks: str):
        """``specials`` is the list of added tokens, or the path of the vocabulary file that has it."""
        import tiktoken

        self._specials({"added_tokens": _added_tokens(specials) if isinstance(specials, str) else specials})
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.spaced, self.pieces, self.long_chars = {}, {}, 0

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        one = self.core.encode_ordinary
        return [array.array("I", one(c)).tobytes() for c in chunks]


_RANKS: dict[str, PairIndexBpe] = {}


def _encoder(tokenizer: str, ranks: str | None, specials: list[dict]) -> PairIndexBpe:
    if tokenizer not in _RANKS:
        _RANKS[tokenizer] = _Ranks(specials, ranks) if ranks else PairIndexBpe(tokenizer)
    return _RANKS[tokenizer]


def pieces(df: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of every whole text: (id, piece, start, length, ids_crc32, part, number).

    A text is its ids and then ``end_id``; null and empty texts are that one id. Only a text above the capacity is cut, into pieces of the
    capacity of which the first may be shorter. ``part`` and ``number`` count the pieces of one length within a task.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "number"]

    specials = _added_tokens(tokenizer)  # read once, as the whole file takes much memory in a worker

    def run(batches):
        bpe = _encoder(tokenizer, ranks, specials)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in groups_of(texts, GROUP_CHARS):
                rows = []
                for key, raw in zip(ids[a:b], bpe.encode_batch(texts[a:b])):
                    raw += end
                    n = len(raw) // 4
                    start = piece = 0
                    size = n % capacity or capacity
                    while start < n:
                        rows.append((key, piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), part, seen[size]))
                        seen[size] += 1
                        start, piece, size = start + size, piece + 1, capacity
                columns = list(zip(*rows))
                kinds = [batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        bpe.forget()

    out = texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, number long")
    return out.withColumnRenamed("id", id_col)


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add (sequence_id, offset) to pieces: gapless sequences of at most the capacity, as few as the plan finds.

    An empty table stays empty. Pieces are told apart by (part, length, number), so that repeated ids are packed each by itself.
    """
    found = staged(found, "pieces")
    by_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    first = by_part.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row for each length up to the capacity
        counts[row["length"]] = row["n"]
    table = slots(plan(counts, capacity), capacity)

    def place(batches):
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            got = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
            number = got["first"] + got["number"]
            row = table[np.searchsorted(key, got["length"] * (1 << 48) + number, side="right") - 1]
            keep = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 2] + number - row[:, 1]), pa.array(row[:, 3])], [*names, "sequence_id", "offset"])

    names = [n for n in found.columns if n not in ("part", "number")]
    schema = ", ".join(f"`{n}` {found.schema[n].dataType.simpleString()}" for n in names)
    return found.join(first, ["part", "length"]).select(*found.columns, "first").mapInArrow(place, f"{schema}, sequence_id long, offset long")
