"""Literal cases of the sequence operators, under several partitionings, with nulls, ties and empty input."""

import math
import time

import pytest
from pyspark.sql import functions as F

from seriate.functions import collectors as C
from seriate.functions import numeric as N
from seriate.functions.joining import Joining
from seriate.operators.seq import Seq
from seriate.plans import order as O
from seriate.sources import sequences as S


@pytest.fixture(params=[1, 5])
def seq(spark, request):
    """Makes a sequence of values in a shuffled, partitioned table with empty partitions."""

    def make(values, kind="int"):
        rows = [(k, v) for k, v in enumerate(values)]
        rows = rows[::2][::-1] + rows[1::2]
        return Seq(spark.createDataFrame(rows, f"_pos bigint, value {kind}").repartition(request.param))

    return make


def only(df):
    (row,) = df.collect()
    return row[0]


def test_scans(seq):
    s = seq([1, 2, 3, 4])
    assert only(s.scan_left("sum", 0)) == [0, 1, 3, 6, 10] and only(s.scan_left("sum")) == [1, 3, 6, 10]
    assert only(s.scan_right("sum", 0)) == [10, 9, 7, 4, 0] and only(s.scan_right("sum")) == [10, 9, 7, 4]
    assert s.prefix("max").to_list() == [1, 2, 3, 4]
    assert only(s.scan_fold(F.lit(1), lambda a, x: a * x)) == [1, 1, 2, 6, 24]
    assert seq([]).scan_left("sum").collect()[0][0] in ([], None)


def test_runs(seq):
    same = lambda a, b: F.substring(a, 1, 1) == F.substring(b, 1, 1)
    s = seq(["aaa", "bb", "baz", "bar", "foo", "fee", "abc"], "string")
    assert s.group_runs(same).to_list() == [["aaa"], ["bb", "baz", "bar"], ["foo", "fee"], ["abc"]]
    assert seq([1, 2, 2, 3, 3, 2, 2, 2, 3, 4, 4, 4, 4, 4, 2]).run_lengths().to_list() == [(1, 1), (2, 2), (3, 2), (2, 3), (3, 1), (4, 5), (2, 1)]
    assert seq([None, None, 1, None]).run_lengths().to_list() == [(None, 2), (1, 1), (None, 1)]
    span = seq([1, *range(3, 100)]).interval_map(lambda a, b: b == a + 1, lambda x, y: F.when(x == y, x.cast("string")).otherwise(F.concat(x.cast("string"), F.lit(".."), y.cast("string"))))
    assert span.to_list() == ["1", "3..99"]
    collapsed = seq([0, 0, 1, 1, 1, 1, 4, 6, 6, 3, 3, 10]).collapse(lambda a, b: a == b)
    assert [r["value"] for r in collapsed.orderBy("_run").collect()] == [0, 1, 4, 6, 3, 10]
    assert seq([]).run_lengths().to_list() == []


def test_dominators_differ_from_collapse(seq):
    s = seq([1, 5, 3, 4, 2, 7])
    assert [r["value"] for r in s.collapse(lambda a, b: a >= b).orderBy("_run").collect()] == [1, 5, 4, 7]
    assert s.dominators().to_list() == [1, 5, 7] and only(s.collect(d=C.dominators)) == [1, 5, 7]


def test_take_and_drop(seq):
    s = seq([1, 2, 9, 1, None, 3])
    assert s.take_while(lambda x: x < 5).to_list() == [1, 2] and s.take_while_inclusive(lambda x: x < 5).to_list() == [1, 2, 9]
    assert s.drop_while(lambda x: x < 5).to_list() == [9, 1, None, 3] and s.take_until_null().to_list() == [1, 2, 9, 1]
    assert s.take_while(lambda x: x < 0).to_list() == [] and s.drop_while(lambda x: x < 100).to_list() == [None, 3]


def test_neighbours(seq):
    s = seq([1, 4, 9, 16])
    assert s.pair_map(lambda a, b: b - a).to_list() == [3, 5, 7] and seq([1]).pair_map(lambda a, b: b - a).to_list() == []
    assert s.with_first(lambda a, b: b - a).to_list() == [0, 3, 8, 15]
    assert s.map_first(lambda x: -x).map_last(lambda x: x * 2).to_list() == [-1, 4, 9, 32] and seq([3]).map_last(lambda x: x + 1).to_list() == [4]
    assert s.intersperse(0).to_list() == [1, 0, 4, 0, 9, 0, 16]
    assert seq([None, None]).pair_map(lambda a, b: F.coalesce(a, F.lit(0))).to_list() == [0]


def test_global_order_meets_windows(spark, monkeypatch):
    """Ranges, carries and borders give what one window would, whatever the ranges are."""
    rows = [(k * 37 % 1009, k, (k * 7919) % 50 - 20 if k % 11 else None) for k in range(1009)]
    df = spark.createDataFrame(rows, "at bigint, tie bigint, v bigint").repartition(7)
    want = sorted(rows)
    for ranges in (1, 3, 64):
        monkeypatch.setattr(O, "MOST_RANGES", ranges)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        try:
            run = O.with_running(df, [], ["at", "tie"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).orderBy("at").collect()
            near = O.with_neighbours(df, [], ["at", "tie"], {"p": F.col("v")}).orderBy("at").collect()
            ahead = O.with_neighbours(df, [], ["at", "tie"], {"p": F.col("v")}, ahead=True).orderBy("at").collect()
            back = O.with_running(df, [], ["at", "tie"], {"s": ("sum", F.lit(1))}, backward=True).orderBy("at").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        total, top = None, None
        for k, (_, _, v) in enumerate(want):
            if v is not None:
                total, top = (total or 0) + v, v if top is None else max(top, v)
            assert (run[k]["s"], run[k]["m"]) == (total, top)
            assert near[k]["p"] == (want[k - 1][2] if k else None) and ahead[k]["p"] == (want[k + 1][2] if k + 1 < len(want) else None)
            assert back[k]["s"] == len(want) - k


def test_ranges_follow_the_whole_order(spark):
    """Where leading columns have few values, the next ones tell ranges apart, so that no range holds most rows."""
    nan = float("nan")
    leads = [None, -1.0, -0.0, 0.0, nan]
    rows = [(0, leads[k % 5], None if k % 7 == 0 else "ab"[k % 2], k) for k in range(4000)]
    df = spark.createDataFrame(rows, "zero int, lead double, text string, id bigint").repartition(5)
    place = lambda r: (-math.inf if r[1] is None else math.inf if r[1] != r[1] else r[1], r[2] or "", r[3])
    want = [r[3] for r in sorted(rows, key=place)]
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for order in (["zero", "lead", "text", "id"], ["lead", "text", "id"], ["text", "id"], ["id"]):
            sizes = [r["count"] for r in O.in_ranges(df, order).groupBy("_range").count().collect()]
            assert len(sizes) == 32 and max(sizes) <= 4000 // 8, order
        for order in (["zero", "lead", "text", "id"], ["lead", "text", "id"]):
            assert [r["id"] for r in O.with_position(df, [], order).orderBy("_pos").collect()] == want
            assert [r["_pos"] for r in O.with_position(df, [], order).select("_pos").orderBy("_pos").collect()] == list(range(4000))
        down = Seq(df.where("lead is not null"), "lead", "id").reverse_sorted()
        sizes = [r["count"] for r in O.in_ranges(down.df, down.order).groupBy("_range").count().collect()]
        assert max(sizes) <= 3200 // 8
        assert [r["id"] for r in down.skip(790).limit(20).ordered().collect()] == [*range(3954, 4000, 5), *range(3, 53, 5)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sets_and_order(seq, spark):
    assert seq([x // 3 for x in range(12)]).distinct(at_least=3).to_list() == [0, 1, 2, 3]
    assert seq([None, 1, None, 1, 2]).distinct().to_list() == [None, 1, 2] and seq([1, None, 3]).without(None, 3).to_list() == [1]
    a, b = seq([1, 2]), seq([8, 9])
    assert a.append(b).to_list() == [1, 2, 8, 9] and a.prepend(b).to_list() == [8, 9, 1, 2] and seq([]).if_empty(b).to_list() == [8, 9] and a.if_empty(b).to_list() == [1, 2]
    assert seq([3, 1, 2]).sorted().to_list() == [1, 2, 3] and seq([3, 1, 2]).reverse_sorted().to_list() == [3, 2, 1]
    words = seq(["bb", "a", "cc", "d"], "string")
    assert words.sorted_by(F.length).to_list() == ["a", "d", "bb", "cc"] and words.sorted_by(F.length, reverse=True).to_list() == ["bb", "cc", "a", "d"]
    assert words.greatest(3, F.length).to_list() == ["bb", "cc", "a"] and words.least(0, F.length).to_list() == []
    with pytest.raises(Exception, match="null has no order"):
        seq([1, None]).sorted().to_list()
    assert seq(range(10)).skip(3).limit(4).to_list() == [3, 4, 5, 6] and seq(range(5)).skip_last(2).to_list() == [0, 1, 2]
    assert seq([5, 6, 7]).move_to_end(lambda x: x == 6).to_list() == [5, 7, 6]
    assert seq(range(7)).batches(3).to_list() == [[0, 1, 2], [3, 4, 5], [6]] and seq(range(4)).sliding(3).to_list() == [[0, 1, 2], [1, 2, 3]]
    assert seq(range(5)).couples().to_list() == [[0, 1], [2, 3]] and seq([1, 2]).append_total().to_list() == [1, 2, 3]
    assert seq(range(7)).every_nth(3).to_list() == [0, 3, 6]


def test_joins(seq):
    a, b = seq([1, 2, 3]), seq(["x", "y"], "string")
    assert a.zip_with(b).to_list() == [(1, "x"), (2, "y")] and a.pairs().to_list() == [(1, 2), (1, 3), (2, 3)]
    with pytest.raises(ValueError):
        a.zip(b)
    assert b.zip(seq([5, 6]), lambda x, y: F.concat(x, y.cast("string"))).to_list() == ["x5", "y6"]
    assert b.cross(a).to_list() == [("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2), ("y", 3)]
    assert seq([1, 0, 1]).elements(b).to_list() == ["y", "x", "y"]


def test_aggregates(seq):
    s = seq([3, None, 1, 3, 1])
    got = s.collect(
        first=C.first, last=C.last, head=C.head(2), tail=C.tail(2), kinds=C.distinct_count, set=C.to_set, lo=C.min_by(), hi=C.max_by(), lo_at=lambda x, at: C.min_index(x, at["_pos"]), hi_at=lambda x, at: C.max_index(x, at["_pos"]),
        least=C.min_all(), most=C.max_all(), text=C.joining("-", "<", ">"), only=C.only_one, by=C.distinct_by(lambda x: x % 2), odd=C.filtering_list(lambda x: x == 1),
    ).first()
    assert (got["first"], got["last"], got["head"], got["tail"], got["kinds"]) == (3, 1, [3, None], [3, 1], 3)
    assert sorted(got["set"], key=str) == [1, 3, None] and (got["lo"], got["hi"], got["lo_at"], got["hi_at"]) == (1, 3, 2, 0)
    assert (got["least"], got["most"], got["text"], got["only"], got["by"], got["odd"]) == ([1, 1], [3, 3], "<3-null-1-3-1>", None, [3, None], [1, 1])
    assert only(s.has(None)) and not only(s.has(7)) and only(s.index_of(lambda x: x == 1)) == 2 and only(seq([]).index_of(lambda x: x == 1)) is None
    assert only(seq([]).all_match(lambda x: x > 0)) and not only(seq([]).any_match(lambda x: x > 0)) and only(s.none_match(lambda x: x > 5))
    assert only(s.non_null().reduce(lambda a, b: a * 10 + b)) == 3131 and only(seq([]).reduce(lambda a, b: a + b)) is None
    assert only(s.non_null().fold_right(F.lit(0), lambda x, a: a * 10 + x)) == 1313


def test_top_values_of_large_groups(spark):
    """Rows are compared with the top of their group, found once: with a top for each row this takes minutes, as it grows with the square."""
    n = 12_000
    rows = spark.range(n).selectExpr("id", "if(id % 3 = 0, null, id % 2) as g", "if(id % 5 = 0, null, (id * 7919) % 50) as k").repartition(5)
    want = {}
    for i in range(n):
        if i % 5:
            want.setdefault(None if i % 3 == 0 else i % 2, {}).setdefault(i * 7919 % 50, []).append(i)
    keyed, key = Seq(rows, "id", "id", "g"), lambda x: F.col("k")
    odd = C.filtering(lambda x: x % 2 == 1, C.max_all(key))
    started = time.monotonic()
    got = {r["g"]: r for r in keyed.collect(most=C.max_all(key), least=C.min_all(key), odd=odd, none=C.max_all(lambda x: F.lit(None).cast("int"))).collect()}
    plain = {r["g"]: r["most"] for r in rows.groupBy("g").agg(C.max_all(key)(F.col("id"), F.col("id")).alias("most")).collect()}
    assert time.monotonic() - started < 40
    assert set(got) == set(want) == {None, 0, 1}
    for g, found in want.items():
        assert got[g]["most"] == plain[g] == found[max(found)] and got[g]["least"] == found[min(found)] and got[g]["none"] == []
        odds = [k for k in found if any(i % 2 for i in found[k])]
        assert got[g]["odd"] == ([i for i in found[max(odds)] if i % 2] if odds else [])
    assert only(Seq(rows, "id", "id").collect(most=C.max_all(key))) == [i for i in range(n) if i % 5 and i * 7919 % 50 == 49]
    assert only(Seq(rows.where("k < 0"), "id", "id").collect(most=C.max_all(key))) == []


def test_first_of_the_greatest_in_large_groups(spark):
    n = 12_000
    rows = spark.range(n).selectExpr("id", "if(id % 3 = 0, null, id % 2) as g", "if(id % 5 = 0, null, if(id % 50 = 7, double('nan'), double((id * 7919) % 50))) as k").repartition(5)
    places = {None: range(0, n, 3), 0: [i for i in range(0, n, 2) if i % 3], 1: [i for i in range(1, n, 2) if i % 3]}
    nan = {g: next((i for i in p if i % 50 == 7), None) for g, p in places.items()}
    want = {g: nan[g] if nan[g] is not None else min((i for i in p if i % 5), key=lambda i: (-(i * 7919 % 50), i)) for g, p in places.items()}
    key, started = lambda x: F.col("k"), time.monotonic()
    got = {r["g"]: r for r in Seq(rows, "id", "id", "g").collect(most=C.max_by(key), few=C.filtering(lambda x: x < 7, C.max_by(key)), none=C.max_by(lambda x: F.lit(None).cast("int"))).collect()}
    plain = {r["g"]: r["most"] for r in rows.groupBy("g").agg(C.max_by(key)(F.col("id"), F.col("id")).alias("most")).collect()}
    assert time.monotonic() - started < 40
    assert {g: r["most"] for g, r in got.items()} == plain == want and {r["none"] for r in got.values()} == {None}
    assert {g: r["few"] for g, r in got.items()} == {g: min((i for i in p if i % 5 and i < 7), key=lambda i: (-(i * 7919 % 50), i)) for g, p in places.items()}
    assert only(Seq(rows, "id", "id").max_by(key)) == 7 and only(Seq(rows.where("k < 0"), "id", "id").max_by(key)) is None
    assert {r["key"]: r["most"] for r in Seq(rows.where("k < 0"), "id", "id").partitioning_by(lambda x: x > 3, most=C.max_by(key)).collect()} == {True: None, False: None}


def test_grouping(seq):
    s = seq(["a", "bb", "c", "dd", "eee"], "string")
    assert {r["key"]: r["value"] for r in s.grouping_by(F.length).collect()} == {1: ["a", "c"], 2: ["bb", "dd"], 3: ["eee"]}
    assert {r["key"]: r["n"] for r in s.partitioning_by(lambda x: F.length(x) > 9, n=lambda x, at: F.count(x)).collect()} == {True: 0, False: 5}
    assert {r["key"]: r["n"] for r in s.grouping_by_domain(F.length, [1, 2, 3, 4], {"n": 0}, n=C.counting).collect()} == {1: 2, 2: 2, 3: 1, 4: 0}
    with pytest.raises(Exception, match="not in the domain"):
        s.grouping_by_domain(F.length, [1, 2], n=C.counting).collect()
    arrays = seq([[1, 2, 3], [2, 3], [3, 2, 2]], "array<int>")
    assert sorted(only(arrays.collect(i=C.intersecting))) == [2, 3] and only(seq([], "array<int>").collect(i=C.intersecting)) == []
    assert only(seq(["hallo", "hall", "halb"], "string").collect(p=C.common_prefix)) == "hal" and only(seq(["xab", "ab", "cab"], "string").collect(p=C.common_suffix)) == "ab"


def test_pairs(spark):
    p = S.of_pairs(spark, [("aaa", [1, 2, 3]), ("bb", [2, 3, 4])], "string", "array<int>")
    inverted = p.flat_map_values(lambda v: v).invert()
    assert {r["value"]: r["key"] for r in inverted.grouping().collect()} == {1: ["aaa"], 2: ["aaa", "bb"], 3: ["aaa", "bb"], 4: ["bb"]}
    q = S.of_map(spark, {"a": 1, "bb": 22, "ccc": 33}, "string", "int")
    assert q.map_keys(F.length).map_to_value(lambda k, v: v + k).to_list() == [(1, 2), (2, 24), (3, 36)]
    assert q.filter_values(lambda v: v > 1).join("=").to_list() == ["bb=22", "ccc=33"] and q.without_keys("a").keys().to_list() == ["bb", "ccc"]
    assert only(q.to_map()) == {"a": 1, "bb": 22, "ccc": 33} and q.prefix_values().values().to_list() == [1, 23, 56]
    twice = q.append(q.map_values(lambda v: v * 10))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        twice.to_map().collect()
    assert only(twice.to_map(lambda values: F.element_at(values, -1))) == {"a": 10, "bb": 220, "ccc": 330}
    with pytest.raises(Exception, match="null key"):
        S.of_pairs(spark, [(None, 1)], "string", "int").without_keys("a").to_list()
    assert S.of_pairs(spark, [(1, 1), (None, 2), (None, 3), (1, 4)], "int", "int").collapse_keys().orderBy("_run").select("value").collect() == [([1],), ([2, 3],), ([4],)]


def test_sources(spark):
    assert [x[0] for x in S.sub_lists(S.range_(spark, 0, 12), 5, 2).to_list()] == [0, 2, 4, 6, 8] and S.sub_lists(S.range_(spark, 0, 12), 5).to_list()[-1] == [10, 11]
    assert S.range_(spark, 3, 0, -1).to_list() == [3, 2, 1] and S.range_(spark, 0, 3, closed=True).to_list() == [0, 1, 2, 3] and S.range_(spark, 3, 0).to_list() == []
    assert S.permutations(spark, 3).to_list() == [[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]
    assert S.combinations(spark, 10, 5).df.count() == 252 and S.combinations(spark, 2, 3).to_list() == [] and S.combinations(spark, 3, 0).to_list() == [[]]
    assert S.cartesian_product(spark, [], "int").to_list() == [[]] and S.cartesian_product(spark, [[1, 2], []], "int").to_list() == []
    assert S.emit("fibonacci", 0, 8).to_list() == [0, 1, 1, 2, 3, 5, 8, 13] and S.emit("collatz", 6, 99).to_list() == [6, 3, 10, 5, 16, 8, 4, 2, 1]
    texts = spark.createDataFrame([(1, ""), (2, "a,b,,"), (3, ",a")], "id int, t string")
    parts = {}
    for r in S.split(texts, "t", ",", ["id"]).df.orderBy("id", "_pos").collect():
        parts.setdefault(r["id"], []).append(r["value"])
    assert parts == {1: [""], 2: ["a", "b"], 3: ["", "a"]}
    one = spark.createDataFrame([(1, "a😀")], "id int, t string")
    assert S.code_points(one, "t", ["id"]).to_list() == [97, 0x1F600] and S.chars(one, "t", ["id"]).to_list() == [97, 0xD83D, 0xDE00]
    edges = [(1, None, "root", 0), (2, 1, "childA", 0), (3, 2, "grandA1", 0), (4, 2, "grandA2", 1), (5, 1, "childB", 1), (6, 5, "grandB1", 0), (7, 1, "childC", 2)]
    tree = S.tree(spark.createDataFrame(edges, "id int, parent int, title string, k int"), "id", "parent", "k", ["title"])
    assert [r["title"] for r in tree.ordered().collect()] == ["root", "childA", "grandA1", "grandA2", "childB", "grandB1", "childC"]
    assert S.iterate(spark, 1, "value * 2", "bigint", "value < 100", 50).to_list() == [1, 2, 4, 8, 16, 32, 64]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Some\nTest\r\nLines\n", encoding="utf-8")
    (tmp_path / "b16.txt").write_text("Some\nÄ\n", encoding="utf-16")
    assert S.lines(spark, str(tmp_path / "a.txt")).to_list() == ["Some", "Test", "Lines"]
    assert S.lines(spark, str(tmp_path / "b16.txt"), "UTF-16").to_list() == ["Some", "Ä"]
    assert S.file_bytes(spark, str(tmp_path / "a.txt")).to_list()[:4] == [83, 111, 109, 101]


def test_numbers(spark):
    row = spark.range(1).select(N.wrap_int(F.lit(2**31)).alias("i"), N.wrap_byte(F.lit(300)).alias("b"), N.wrap_short(F.lit(-32769)).alias("s"), N.char_code(F.lit(-1)).alias("c")).first()
    assert tuple(row) == (-(2**31), 44, 32767, 65535)
    big = spark.createDataFrame([(2**63 - 1,), (2,)], "x bigint")
    assert big.agg(N.sum_long(F.col("x"))).first()[0] == -(2**63) + 1 and big.limit(0).agg(N.sum_int(F.col("x"))).first()[0] == 0
    doubles = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (-1.0,)], "x double")
    ordered = [r[0] for r in doubles.orderBy(N.total_order(F.col("x"))).collect()]
    assert ordered[0] == -1.0 and math.copysign(1, ordered[1]) == -1 and math.copysign(1, ordered[2]) == 1 and math.isnan(ordered[3])
    assert math.isnan(doubles.agg(N.min_double(F.col("x"))).first()[0]) and Seq(doubles.withColumn("_pos", F.lit(0)), "x").greater(-0.5).df.count() == 2


def test_bounded_joining(seq):
    words = ["one", "two three", "four five", "six seven"]
    s = seq(words, "string")
    j = Joining(", ").max_chars(25)
    assert only(s.collect(t=j.cut_before_delimiter())) == "one, two three..." and only(s.collect(t=j.cut_after_delimiter())) == "one, two three, ..."
    assert only(s.collect(t=j.cut_anywhere())) == ", ".join(words)[:22] + "..."
    assert only(s.collect(t=j.cut_at_word())) == "one, two three, four ..."
    assert only(s.collect(t=Joining(", ").max_elements(2))) == "one, two three, ..." and only(s.collect(t=Joining(", ").max_elements(9))) == ", ".join(words)
    assert Joining("", "<<<<", ">>>>").max_chars(5).join(["x"]) == "<<<<>" and Joining(",").max_chars(2).join(["abc", "d"]) == ".."
    assert Joining("").max_graphemes(4).cut_at_grapheme().join(["é", "x", "y", "z", "w"]) == "é..."
    assert Joining(",").max_chars(100).join([]) == ""


def test_short_forms(seq):
    s = seq([5, 2, 9, 2])
    assert only(s.sum()) == 18 and only(s.average()) == 4.5 and only(s.min()) == 2 and only(s.max()) == 9 and only(seq([]).sum()) == 0
    assert only(seq([2**31 - 1, 1]).sum()) == -(2**31) and math.isnan(only(seq([1.0, float("nan")], "double").min()))
    assert only(s.min_by(lambda x: -x)) == 9 and only(s.max_by(lambda x: x % 4)) == 2 and only(s.joining("+")) == "5+2+9+2"
    assert only(s.reduce_with_zero(0, lambda a, x: a * x, 1)) == 180 and only(seq([3, 0, 7]).reduce_with_zero(0, lambda a, x: a * x, 1)) == 0
    assert only(s.to_map(lambda x: x % 3, merge=F.size)) == {2: 3, 0: 1} and [tuple(e) for e in only(s.to_sorted_map(lambda x: x, lambda x: -x, lambda v: F.get(v, 0)))] == [(2, -2), (5, -5), (9, -9)]
    assert only(s.to_bit_set()) == [2, 5, 9] and only(s.to_flat_list(lambda x: F.sequence(x, x + 1))) == [5, 6, 2, 3, 9, 10, 2, 3]
    assert only(seq([97, 0x1F600]).code_points_to_string()) == "a😀" and only(seq([97, 0xD83D, 0xDE00]).chars_to_string()) == "a😀"
    seen = []
    s.peek_first(seen.append).peek_last(seen.append)
    assert seen == [5, 2] and seq([1, 255, 256]).to_bytes() == b"\x01\xff\x00"
