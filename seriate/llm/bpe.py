"""Operator 3: byte-level BPE encoding and decoding over a pair occurrence index.

A batch's distinct pre-tokens stand one after another as one sequence of symbols. The index maps each
adjacent pair that has a merge to all its positions in the batch. Active ranks are applied in ascending
order from a heap; each application rewrites every listed position and updates the lists of the pairs to the
left and right. A merge's result can only take part in later ranks, so one ascending pass is exact.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts_of

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded chunks that a worker keeps; when full, the memory is cleared and filled anew.
CACHE_ENTRIES = 250_000
#: Characters of kept parts that are longer than 64 each; beyond it the memory is cleared, too.
CACHE_CHARS = 8_000_000

_GAP = re.compile(r" (?=\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Strings:
    """Byte strings by number, laid out end to end, so that those of a whole batch of numbers are gathered at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - stops + lengths, lengths)
        at += np.arange(len(at))
        return self.data[at], stops


class PairIndexBpe:
    """Encoder and decoder of a ``tokenizers`` byte-level BPE file."""

    #: CACHE_ENTRIES that this encoder keeps: a cache that is less than the common words of a task is filled anew for each batch.
    caches = 4

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self._specials(spec)
        self.table: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in vocab.items():
            self.table[k] = token.encode() if token in self.special else bytes(letters[x] for x in token)
        for token, k in self.special.items():
            self.table[k] = token.encode()
        self.tokens = Strings(self.table)
        self.decimals = Strings([b"%d," % k for k in range(len(self.table))])
        self.byte_id = [vocab[x] for x, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: A pair of ids, packed into one integer, -> its rank; rank -> left, right, merged id.
        self.merges: dict[int, int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 16 | vocab[b]] = rank
            self.by_rank.append((vocab[a], vocab[b], vocab[a + b]))
        self.byte_ids = np.array(self.byte_id, dtype=np.int32)
        self.byte_ranks = np.array([[self.merges.get(a << 16 | b, -1) for b in self.byte_id] for a in self.byte_id], dtype=np.int32)
        self.pattern = regex.compile(PATTERN)
        self.spaced: dict[str, bytes] = {}  # parts after a space
        self.pieces: dict[str, bytes] = {}  # pre-tokens
        self.long_chars = 0

    def _specials(self, spec: dict) -> None:
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, by one pass over the pair occurrence index of all of them."""
        get = self.merges.get
        joined = b"\0".join(words) + b"\0"
        raw = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        ids = self.byte_ids[raw]
        ids[ends] = -1
        n = len(ids)
        ranks = self.byte_ranks[raw[:-1], raw[1:]]
        ranks[ends[:-1]] = -1
        ranks[ends - 1] = -1
        found = np.flatnonzero(ranks >= 0)
        order = found[np.argsort(ranks[found], kind="stable")]
        first, cuts = np.unique(ranks[order], return_index=True)
        #: rank -> positions, for the pairs that occur now; each is applied once, in ascending order.
        index = {r: p.tolist() for r, p in zip(first.tolist(), np.split(order, cuts[1:]))} if len(order) else {}
        symbols = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = list(index)
        heapq.heapify(heap)
        by_rank, push = self.by_rank, heapq.heappush
        while heap:
            rank = heapq.heappop(heap)
            left, right, merged = by_rank[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()  # runs such as "aaa" merge leftmost first
            high = merged << 16
            for i in places:
                if symbols[i] != left:
                    continue
                j = after[i]
                if symbols[j] != right:
                    continue
                k = after[j]
                symbols[i], symbols[j] = merged, -2
                after[i] = k
                before[k] = i
                s = symbols[k]
                if s >= 0:
                    r = get(high | s)
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(heap, r)
                h = before[i]
                if h >= 0:
                    s = symbols[h]
                    if s >= 0:
                        r = get(s << 16 | merged)
                        if r is not None:
                            if r in index:
                                index[r].append(h)
                            else:
                                index[r] = [h]
                                push(heap, r)
        flat = np.array(symbols, dtype=np.int32)
        flat = flat[flat != -2]
        stops = np.flatnonzero(flat == -1).tolist()
        flat = flat.astype("<u4").tobytes()
        out, at = [], 0
        for stop in stops:
            out.append(flat[4 * at : 4 * stop])
            at = stop + 1
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of parts of texts, each encoded by itself; a part that is one pre-token is kept by the caller only."""
        findall, kept = self.pattern.findall, self.pieces
        split = list(map(findall, chunks))
        several = {x for p in split if len(p) > 1 for x in p if x not in kept}
        single = {p[0] for p in split if len(p) == 1 and p[0] not in kept}
        single -= several
        new = [*several, *single]
        if not new:
            return [b"".join([kept[x] for x in p]) for p in split]
        ids = self.encode_words([p.encode() for p in new])
        kept.update(zip(several, ids))
        alone = dict(zip(single, ids[len(several) :]))
        return [(alone[p[0]] if p[0] in alone else kept[p[0]]) if len(p) == 1 else b"".join([kept[x] for x in p]) for p in split]

    def _cut(self, text: str) -> list[str]:
        """The parts of a text that can be encoded each by itself; all but the first stand without their leading space.

        A pre-token holds a space only as its first character or within a run of white space, so a text may be cut before every
        space that stands before something other than white space.
        """
        parts = text.split(" ")
        if _GAP.search(text) is None:
            return parts
        out, own = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(own)
                own = p
            else:
                own += " " + p
        out.append(own)
        return out

    def forget(self) -> None:
        """Empty the memory of encoded parts."""
        self.spaced.clear()
        self.pieces.clear()
        self.long_chars = 0

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, little-endian with four bytes each."""
        spaced, special = self.spaced, self.special
        if len(spaced) + len(self.pieces) > self.caches * CACHE_ENTRIES or self.long_chars > CACHE_CHARS:
            self.forget()
        get = spaced.get
        heads: list[str] = []
        jobs: list[tuple[int, int, list[str], list[bytes | None]]] = []  # text, its first part's place in heads, the other parts, their ids
        for k, text in enumerate(texts):
            for piece in self.split.split(text) if self.split is not None and any(s in text for s in special) else (text,):
                if piece in special:
                    jobs.append((k, -1, [], [np.array([special[piece]], dtype="<u4").tobytes()]))
                elif piece:
                    parts = self._cut(piece)
                    heads.append(parts.pop(0))
                    jobs.append((k, len(heads) - 1, parts, list(map(get, parts))))
        missing: set[str] = set()
        for _, _, parts, got in jobs:
            if None in got:
                missing.update([p for p, ids in zip(parts, got) if ids is None])
        new = list(missing)
        fresh = self.ids_of([*heads, *map(" ".__add__, new)])
        self.long_chars += sum([len(p) for p in new if len(p) > 64])
        spaced.update(zip(new, fresh[len(heads) :]))
        found: list[list[bytes]] = [[] for _ in texts]
        for k, head, parts, got in jobs:
            if None in got:
                got = list(map(spaced.__getitem__, parts))
            if head >= 0:
                found[k].append(fresh[head])
            found[k] += got
        return [b"".join(x) for x in found]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


_ENCODERS: dict[str, PairIndexBpe] = {}


def encoder(path: str) -> PairIndexBpe:
    """One encoder for each Python worker and file, so that its cache serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexBpe(path)
    return _ENCODERS[path]


def groups_of(texts: list[str], most_chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with a bounded number of characters, or one longer text."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > most_chars:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; a null or empty text has an empty array. Rows are neither merged nor dropped."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in groups_of(texts):
                raw = bpe.encode_batch(texts[a:b])
                offsets = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["id", "ids"])

    return texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again and return the digests of both.

    Columns: the id, n_tokens long, ids_sha256, decoded_sha256. A null text counts as empty (no tokens, digests of the empty
    string). Repeated rows give repeated results; other columns of the input are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(tokenizer)
        sha = hashlib.sha256
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in groups_of(texts):
                raw = bpe.encode_batch(texts[a:b])
                n = [len(x) // 4 for x in raw]
                ids = np.frombuffer(b"".join(raw), dtype="<u4")
                ends = np.cumsum(n)
                digests = []
                for table, comma in ((bpe.decimals, 1), (bpe.tokens, 0)):
                    data, stops = table.gather(ids)
                    view, own, at = memoryview(data), [], 0
                    for k, size in zip(ends.tolist(), n):
                        stop = int(stops[k - 1]) if k else 0
                        part = view[at : stop - comma if size else at]
                        own.append(sha(part if comma else str(part, "utf-8", "replace").encode()).hexdigest())
                        at = stop
                    digests.append(pa.array(own, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *digests], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
