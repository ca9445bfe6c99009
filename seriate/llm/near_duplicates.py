"""Operator 7: near duplicates by min-max hashing.

Each random permutation gives a set's minimum and its maximum, so that a signature of 2k values takes k hash evaluations. The values
are banded; classes of equal sets that meet in a band are linked to the member that meets most others there, and every link is
confirmed on full sets. Classes of a bucket that are still apart are then compared with each other, so that no link is lost to the
choice of a bucket's centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rows_with, shingles, staged, text_slices, texts_of, words
from .components import components

#: Bands and values a band. A pair at the threshold of 0.8 misses all bands with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
#: Buckets up to this size compare what is still apart pair by pair; larger ones block by block, with as many members a block.
SMALL_BUCKET, BLOCK = 32, 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of every row, by row and hash; a row with fewer words has one of all its words."""
    rows_n = len(offsets) - 1
    _, _, hashes, rows = words(data, offsets)
    keys, of, _ = shingles(hashes, rows, n)
    counts = np.bincount(rows, minlength=rows_n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        own = np.zeros(len(short), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                has = counts[short] > k
                own[has] = own[has] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[first[short[has]] + k]
            own += counts[short].astype(np.uint64)
        keys, of = np.append(keys, mix(own)), np.append(of, short)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[fresh], of[fresh]


def band_keys(keys: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The band keys of each set (keys from ``first[i]`` on): an array of sets by bands, from min-max signatures."""
    k = -(-bands * rows // 2)
    rng = np.random.default_rng(20_240_607)
    factors = rng.integers(0, 1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, size=k, dtype=np.uint64)
    out = np.zeros((bands, len(first)), dtype=np.uint64)
    values: list[np.ndarray] = []
    band = 0
    with np.errstate(over="ignore"):
        for a, b in zip(factors, offsets):
            x = keys * a + b
            values += [np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)]
            while len(values) >= rows and band < bands:
                h = np.full(len(first), np.uint64(band + 1))
                for v in values[:rows]:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v)
                out[band] = h
                values = values[rows:]
                band += 1
    return out.T


def signatures(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands): the size of a text's set, 128 bits that name it, and its band keys (null if empty)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                keys, of = shingle_sets(data, offsets, n)
                size = np.bincount(of, minlength=b - a)
                full = np.flatnonzero(size)
                first = (np.cumsum(size) - size)[full]
                one, two = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                bands: list = [None] * (b - a)
                if len(full):
                    with np.errstate(over="ignore"):
                        one[full] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), first)
                        two[full] = np.add.reduceat(mix(keys + np.uint64(0x14057B7EF767814F)), first)
                    for k, row in zip(full.tolist(), band_keys(keys, first).view(np.int64)):
                        bands[k] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def sets_of(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """The kept columns and the set of the column ``text`` as sorted 64-bit hashes in a binary column ``hashes``."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(len(keep))):
                keys, of = shingle_sets(data, offsets, n)
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                own = [keys[cuts[k] : cuts[k + 1]].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(own, pa.binary())], [*keep, "hashes"])

    return df.select(*keep, "text").mapInArrow(run, f"{schema}, hashes binary")


def _likeness(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum()) if len(y) else 0
    return same, len(x) + len(y) - same


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids those whose sets satisfy 100 * intersection >= percent * union.

    Only texts that a pair names leave their task, cut into sets; those of the first members then meet those of the second by id. The
    joins are hinted so that they are planned alike at every size.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    named = staged(sets_of(rows_with(texts, ["id"], ids), n, ["id"]), "sets")
    left = pairs.hint("merge").join(named.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.hint("merge").join(named.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                same, union = _likeness(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                keep.append(100 * same >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _blocks(big: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the components of large buckets (key, id, component, m), found block by block on full sets.

    A bucket's largest component needs no comparison within itself: the bucket's other members ask it, once for all buckets in which they
    meet it, and each other. Askers and asked are dealt into blocks of about BLOCK; each pair of blocks is one group, which counts
    intersections over an inverted index of the asked. Within a group one link for each pair of components is enough.
    """
    sizes = big.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("target"))
    kind = big.schema["id"].dataType.simpleString()
    dealt = big.join(largest, "key")
    others = dealt.where("component <> target")
    # Groups of askers and asked: of a target component, named by it, and of the rest of a bucket, named by its key.
    of_target, of_key = F.concat(F.lit("component "), F.col("target").cast("string")), F.concat(F.lit("bucket "), F.col("key").cast("string"))
    among = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = others.join(among, "key").select(of_key.alias("group"), "id", "component")
    asking = staged(others.select(of_target.alias("group"), "id", "component").distinct().unionByName(rest), "asking")
    asked = staged(dealt.where("component = target").select(of_target.alias("group"), "id", "component").distinct().unionByName(rest), "asked")
    count = lambda d, name: d.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    numbers = count(asking, "askers").join(count(asked, "blocks"), "group")
    block = lambda size: F.pmod(F.xxhash64("id"), F.col(size)).cast("int")
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = asking.join(numbers, "group").select("group", "id", "component", F.lit(True).alias("asks"), block("askers").alias("i"), spread("blocks").alias("j"))
    right = asked.join(numbers, "group").select("group", "id", "component", F.lit(False).alias("asks"), spread("askers").alias("i"), block("blocks").alias("j"))
    both = left.unionByName(right)
    named = staged(sets_of(rows_with(texts, ["id"], big.select("id")), n, ["id"]), "block-sets")

    def run(table: pa.Table) -> pa.Table:
        ids, comps, asks = (table.column(c).to_pylist() for c in ("id", "component", "asks"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        right, left = [k for k, q in enumerate(asks) if not q], [k for k, q in enumerate(asks) if q]
        parent: dict = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found: list[tuple] = []
        if left and right:
            keys = np.concatenate([sets[k] for k in right])
            owner = np.repeat(np.arange(len(right)), [len(sets[k]) for k in right])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            sizes = np.array([len(sets[k]) for k in right])
            for k in left:
                lo, hi = np.searchsorted(keys, sets[k]), np.searchsorted(keys, sets[k], side="right")
                many = hi - lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                same = np.bincount(owner[at], minlength=len(right))
                for o in np.flatnonzero(100 * same >= percent * (len(sets[k]) + sizes - same)).tolist():
                    x, y = root(comps[k]), root(comps[right[o]])
                    if x != y:
                        parent[x] = y
                        found.append((ids[k], ids[right[o]]))
        kind_ = table.schema.field("id").type
        return pa.table({"a": pa.array([x for x, _ in found], kind_), "b": pa.array([y for _, y in found], kind_)})

    return both.hint("merge").join(named, "id").groupBy("group", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row, by links with 100 * intersection >= percent * union.

    Texts are lower-cased in A-Z and cut at ASCII white space; a text's set is its distinct n-word shingles, or all its words as one
    where it has fewer. A null, empty or blank text has an empty set and links with nothing. ``component_id`` is the least id that
    links reach, the row's own included; a row is kept if that is its own id. Rows with one id count as one text each and share the
    component; rows with a null id stand by themselves, with a null component, and are kept. Extra columns are ignored.
    """
    kind = df.schema[id_col].dataType
    own = staged(signatures(df, n, id_col, text_col), "signatures")
    classes = own.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("class"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    # Equal ids in different classes would be one node; a text is fetched by its id, so that such ids meet as links do.
    members = classes.select("class", F.explode("bands").alias("key"))
    met = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = staged(members.join(met, "key").select("key", F.col("class").alias("id"), "m"), "met")
    centre = met.join(met.groupBy("id").agg(F.sum("m").alias("score")), "id")
    centre = centre.groupBy("key").agg(F.max(F.struct("score", (-F.xxhash64("id").cast("decimal(20,0)")).alias("tie"), "id")).alias("top")).select("key", F.col("top.id").alias("b"))
    pairs = met.join(centre, "key").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    pairs = staged(pairs, "pairs")
    texts = texts_of(df, df[id_col].alias("id"), df[text_col].alias("text"))
    links = staged(confirmed(pairs, texts, n, percent), "links")
    found = components(links)
    # Members of a bucket that the links of its centre left apart.
    named = met.join(found, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("component"))
    apart = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    named = staged(named.join(apart, "key", "left_semi"), "apart")
    small = named.where(F.col("m") <= SMALL_BUCKET)
    x, y = small.select("key", F.col("id").alias("a"), F.col("component").alias("p")), small.select("key", F.col("id").alias("b"), F.col("component").alias("q"))
    rest = x.join(y, "key").where("a < b and p <> q").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = confirmed(staged(rest, "rest"), texts, n, percent)
    large = named.where(F.col("m") > SMALL_BUCKET)
    if not large.isEmpty():
        more = more.unionByName(_blocks(large, texts, n, percent))
    more = staged(more, "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    by_class = classes.join(found, classes["class"] == found["id"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "class").alias("component"))
    out = own.drop("bands").join(by_class, ["set_a", "set_b", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast(kind))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
