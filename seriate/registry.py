"""Queries over the test tables, one or more for each family of operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import collectors as C
from .functions import numeric as N
from .functions.joining import Joining
from .operators.pairs import Pairs
from .operators.seq import Seq
from .plans.order import join_keys
from .sources import sequences as S
from .sources.tables import ORDERS, table

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


def events(spark: SparkSession, d: str, value: str = "event_type") -> Seq:
    """Each user's events in order."""
    return Seq(table(spark, d, "events").withColumn("amount", F.floor("value")), value, "event_id", "user_id")


def orders(spark: SparkSession, d: str, value: str, by=()) -> Seq:
    df = table(spark, d, "orders").withColumn("cents", F.floor("o_totalprice"))
    return Seq(df, value, ORDERS["orders"], by)


_E = "e as (select *, cast(floor(value) as bigint) as amount from events)"
_RUN = f"""{_E}, a as (select *, case when event_type is not distinct from lag(event_type) over w or row_number() over w = 1 then 0 else 1 end as brk
 from e window w as (partition by user_id order by event_id)),
 r as (select *, cast(sum(brk) over (partition by user_id order by event_id) as bigint) as run from a)"""


# -- runs


@query(f"with {_RUN} select user_id, run, min(event_type) as event_type, count(*) as n from r group by all")
def run_lengths(spark, d):
    out = events(spark, d).run_lengths().df
    return out.select("user_id", F.col("_run").alias("run"), F.col("key").alias("event_type"), F.col("value").alias("n"))


@query(f"with {_RUN} select user_id, run, min(event_id) as first_id, max(event_id) as last_id, sum(amount)::bigint as total from r group by all")
def collapse(spark, d):
    seq = events(spark, d)
    return seq.collapse(lambda a, b: a.eqNullSafe(b), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("amount").alias("total"), name="run")


@query(f"with {_RUN} select user_id, run, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from r group by all")
def group_runs(spark, d):
    seq = events(spark, d)
    runs = Seq(seq.islands(lambda a, b: a.eqNullSafe(b)), "event_id", "event_id", ["user_id", "_run"])
    return runs.collect(ids=C.joining(",")).withColumnRenamed("_run", "run")


@query(
    """with a as (select *, case when event_id - lag(event_id) over w <= 100 or row_number() over w = 1 then 0 else 1 end as brk from events
 window w as (partition by user_id order by event_id)), r as (select *, sum(brk) over (partition by user_id order by event_id) as run from a)
 select user_id, cast(run as bigint) as run, cast(min(event_id) as varchar) || '..' || cast(max(event_id) as varchar) as span from r group by user_id, run"""
)
def interval_map(spark, d):
    seq = events(spark, d, "event_id").map_to_long()
    seq = Seq(seq.df.withColumn("at", F.col("event_id")), "event_id", "at", "user_id")
    out = seq.interval_map(lambda a, b: b - a <= 100, lambda lo, hi: F.concat(lo.cast("string"), F.lit(".."), hi.cast("string")))
    return out.df.select("user_id", F.col("_run").alias("run"), F.col("event_id").alias("span"))


@query(f"with {_RUN} select user_id, run, min(event_type) as event_type, string_agg(cast(amount as varchar), '+' order by event_id) as amounts from r group by all")
def collapse_keys(spark, d):
    seq = events(spark, d)
    out = Pairs(seq.df, "event_type", "amount", "event_id", "user_id").collapse_keys(C.joining("+")(F.col("amount"), F.struct("event_id")).alias("amounts"), name="run")
    return out


@query(
    """with a as (select event_id, user_id, case when user_id > lag(user_id) over (order by event_id) or event_id = (select min(event_id) from events) then 0 else 1 end as brk from events),
 r as (select *, cast(sum(brk) over (order by event_id) as bigint) as run from a) select run, count(*) as n, min(user_id) as lo, max(user_id) as hi from r group by run"""
)
def collapse_global(spark, d):
    seq = Seq(table(spark, d, "events"), "user_id", "event_id")
    return seq.collapse(lambda a, b: b > a, F.count("*").alias("n"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), name="run")


# -- neighbours and running operators


@query("select user_id, event_id, event_id - lag(event_id) over w as gap from events window w as (partition by user_id order by event_id) qualify lag(event_id) over w is not null")
def pair_map(spark, d):
    seq = Seq(table(spark, d, "events").withColumn("gap", F.col("event_id")), "gap", "event_id", "user_id")
    return seq.pair_map(lambda a, b: b - a).df.select("user_id", "event_id", "gap")


@query("select o_orderkey, o_custkey - lag(o_custkey) over w as step from orders window w as (order by o_orderkey) qualify lag(o_custkey) over w is not null")
def pair_map_global(spark, d):
    return Seq(table(spark, d, "orders").withColumn("step", F.col("o_custkey")), "step", "o_orderkey").pair_map(lambda a, b: b - a).df.select("o_orderkey", "step")


@query(f"with {_E} select event_id, user_id, cast(sum(amount) over (partition by user_id order by event_id) as bigint) as amount from e")
def prefix_sum(spark, d):
    return events(spark, d, "amount").prefix("sum").df.select("event_id", "user_id", "amount")


@query("select o_orderkey, cast(sum(cast(floor(o_totalprice) as bigint)) over (order by o_orderkey rows unbounded preceding) as bigint) as total, cast(max(cast(floor(o_totalprice) as bigint)) over (order by o_orderkey rows unbounded preceding) as bigint) as top from orders")
def prefix_global(spark, d):
    from .plans.order import with_running

    df = orders(spark, d, "cents").df
    return with_running(df, [], ["o_orderkey"], {"total": ("sum", F.col("cents")), "top": ("max", F.col("cents"))}).select("o_orderkey", "total", "top")


@query("select event_id, user_id, min(event_type) over (partition by user_id order by event_id) as event_type from events")
def prefix_min(spark, d):
    return events(spark, d).prefix("min").df.select("event_id", "user_id", "event_type")


@query(
    f"""with {_E}, s as (select user_id, event_id, sum(amount) over (partition by user_id order by event_id) as x from e)
 select user_id, '100,' || string_agg(cast(cast(100 + x as bigint) as varchar), ',' order by event_id) as sums from s group by user_id"""
)
def scan_left(spark, d):
    return events(spark, d, "amount").scan_left("sum", 100).select("user_id", F.array_join(F.transform("amount", lambda x: x.cast("string")), ",").alias("sums"))


@query(
    f"""with {_E}, s as (select user_id, event_id, sum(amount) over (partition by user_id order by event_id desc) as x from e)
 select user_id, string_agg(cast(cast(x as bigint) as varchar), ',' order by event_id) as sums from s group by user_id"""
)
def scan_right(spark, d):
    return events(spark, d, "amount").scan_right("sum").select("user_id", F.array_join(F.transform("amount", lambda x: x.cast("string")), ",").alias("sums"))


_FLAG = f"with {_E}, f as (select *, max(case when amount < 150 then 0 else 1 end) over w as bad, coalesce(max(case when amount < 150 then 0 else 1 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as earlier from e window w as (partition by user_id order by event_id rows unbounded preceding))"


@query(f"{_FLAG} select user_id, event_id from f where bad = 0")
def take_while(spark, d):
    return events(spark, d, "amount").take_while(lambda x: x < 150).df.select("user_id", "event_id")


@query(f"{_FLAG} select user_id, event_id from f where earlier = 0")
def take_while_inclusive(spark, d):
    return events(spark, d, "amount").take_while_inclusive(lambda x: x < 150).df.select("user_id", "event_id")


@query(f"{_FLAG} select user_id, event_id from f where bad = 1")
def drop_while(spark, d):
    return events(spark, d, "amount").drop_while(lambda x: x < 150).df.select("user_id", "event_id")


@query("select user_id, event_id, first_value(event_type) over (partition by user_id order by event_id) || '>' || event_type as event_type from events")
def with_first(spark, d):
    return events(spark, d).with_first(lambda a, b: F.concat(a, F.lit(">"), b)).df.select("user_id", "event_id", "event_type")


@query("select event_id, user_id, case when lag(event_id) over w is null then upper(event_type) when lead(event_id) over w is null then reverse(event_type) else event_type end as event_type from events window w as (partition by user_id order by event_id)")
def map_first_last(spark, d):
    return events(spark, d).map_last(F.reverse).map_first(F.upper).df.select("event_id", "user_id", "event_type")


@query(f"with {_E}, m as (select *, max(amount) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as top from e) select user_id, event_id, amount from m where top is null or amount > top")
def dominators(spark, d):
    return events(spark, d, "amount").dominators().df.select("user_id", "event_id", "amount")


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as _pos from orders")
def positions_global(spark, d):
    return orders(spark, d, "cents").positions().df.select("o_orderkey", "_pos")


@query("with p as (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) select user_id, event_id from p where i % 3 = 0")
def every_nth(spark, d):
    return events(spark, d).every_nth(3).df.select("user_id", "event_id")


@query("with p as (select *, (row_number() over (partition by user_id order by event_id) - 1) // 4 as b from events) select user_id, cast(b as bigint) as batch, string_agg(event_type, ',' order by event_id) as types from p group by user_id, b")
def batches(spark, d):
    return events(spark, d).batches(4).df.select("user_id", F.col("_batch").alias("batch"), F.array_join("event_type", ",").alias("types"))


@query("select user_id, row_number() over w - 1 as at, event_type || ',' || lead(event_type, 1) over w || ',' || lead(event_type, 2) over w as types from events window w as (partition by user_id order by event_id) qualify lead(event_type, 2) over w is not null")
def sliding(spark, d):
    return events(spark, d).sliding(3).df.select("user_id", F.col("_window").cast("bigint").alias("at"), F.array_join("event_type", ",").alias("types"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) > 2")
def skip_last(spark, d):
    return events(spark, d).skip_last(2).df.select("user_id", "event_id")


# -- filters and projections


@query(f"with {_E} select event_id, amount * 2 as amount from e where amount >= 50 and amount < 400 and event_type not in ('click', 'view') and not (amount >= 100 and amount < 120)")
def filters(spark, d):
    seq = events(spark, d).without("click", "view")
    seq = Seq(seq.df, "amount", "event_id", "user_id").at_least(50).less(400).remove(lambda x: (x >= 100) & (x < 120))
    return seq.map(lambda x: x * 2).df.select("event_id", "amount")


@query("select o_orderkey, o_orderstatus as status, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_totalprice > 1000 and o_totalprice <= 200000")
def filter_by(spark, d):
    seq = orders(spark, d, "o_totalprice").filter_by(lambda x: F.col("o_orderpriority"), "1-URGENT").greater(1000.0).at_most(200000.0)
    return seq.df.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")


@query("select p_partkey, case when p_size > 25 then p_size end as p_size from part where p_size > 25")
def map_partial(spark, d):
    return Seq(table(spark, d, "part"), "p_size", "p_partkey").map_partial(lambda x: F.when(x > 25, x)).df.select("p_partkey", "p_size")


@query("select o_orderkey, cast(case when o_orderkey * 77 % 256 >= 128 then o_orderkey * 77 % 256 - 256 else o_orderkey * 77 % 256 end as bigint) as byte, cast(case when o_orderkey * 7717 % 65536 >= 32768 then o_orderkey * 7717 % 65536 - 65536 else o_orderkey * 7717 % 65536 end as bigint) as short, cast(o_orderkey * 7717 % 65536 as bigint) as code from orders")
def narrowing(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", N.wrap_byte(k * 77).cast("bigint").alias("byte"), N.wrap_short(k * 7717).cast("bigint").alias("short"), N.char_code(k * 7717).cast("bigint").alias("code"))


@query("select doc_id, cast(k - 1 as bigint) as at, w as word from (select doc_id, unnest(string_split(text, chr(10))) as w, generate_subscripts(string_split(text, chr(10)), 1) as k from documents) where w <> ''")
def flat_map(spark, d):
    seq = Seq(table(spark, d, "documents"), "text", "doc_id").flat_map(lambda x: F.split(x, "\n")).filter(lambda x: x != "")
    return seq.df.select("doc_id", F.col("_sub1").cast("bigint").alias("at"), F.col("text").alias("word"))


@query("select doc_id, cast(k - 1 as bigint) as at, w as word from (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as k from documents) where w <> ''")
def flat_map_words(spark, d):
    seq = Seq(table(spark, d, "documents"), "text", "doc_id").flat_map(lambda x: F.split(x, " ")).filter(lambda x: x != "")
    return seq.df.select("doc_id", F.col("_sub1").cast("bigint").alias("at"), F.col("text").alias("word"))


@query("select n_nationkey, unnest(case when n_nationkey = 0 then [n_name] else ['-', n_name] end) as n_name, generate_subscripts(case when n_nationkey = 0 then [n_name] else ['-', n_name] end, 1)::bigint as at from nation")
def intersperse(spark, d):
    seq = Seq(table(spark, d, "nation"), "n_name", "n_nationkey").intersperse("-")
    return seq.df.select("n_nationkey", "n_name", (F.col("_sub1") + 1).cast("bigint").alias("at"))


# -- sort, limit, top


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")
def sorted_limit(spark, d):
    return orders(spark, d, "o_totalprice").reverse_sorted().skip(5).limit(20).df.select("o_orderkey")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id) between 3 and 6")
def limit_skip(spark, d):
    return events(spark, d).skip(2).limit(4).df.select("user_id", "event_id")


@query("select o_custkey, o_orderkey, cast(rank as bigint) as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def greatest_n(spark, d):
    return orders(spark, d, "o_totalprice", ["o_custkey"]).greatest(3).df.select("o_custkey", "o_orderkey", F.col("_rank").cast("bigint").alias("rank"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate limit 25")
def least_n(spark, d):
    return Seq(table(spark, d, "lineitem"), "l_quantity", ORDERS["lineitem"]).least(25).df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("select p_brand, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as parts from (select *, rank() over (partition by p_brand order by p_size desc) as r from part) where r = 1 group by p_brand")
def max_all(spark, d):
    seq = Seq(table(spark, d, "part"), "p_partkey", "p_partkey", "p_brand")
    return seq.collect(parts=C.and_then(C.max_all(lambda x: F.col("p_size")), lambda a: F.array_join(a.cast("array<string>"), ",")))


@query("select c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) as least, max(c_custkey) filter (c_acctbal = top) as most from (select *, max(c_acctbal) over (partition by c_nationkey) as top from customer) group by c_nationkey")
def min_max_by(spark, d):
    seq = Seq(table(spark, d, "customer"), "c_custkey", "c_custkey", "c_nationkey")
    last = F.when(F.col("c_acctbal").isNotNull(), F.struct("c_acctbal", "c_custkey"))  # of equal balances max_by takes the first
    return seq.collect(least=C.min_by(lambda x: F.col("c_acctbal")), most=C.max_by(lambda x: last))


@query("with p as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i from customer) select c_nationkey, arg_min(i, (c_mktsegment, i)) as lo, arg_max(i, (c_mktsegment, -i)) as hi from p group by c_nationkey")
def min_max_index(spark, d):
    rows = Seq(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_nationkey").positions("i").df
    x, i = F.col("c_mktsegment"), F.col("i")
    return rows.groupBy("c_nationkey").agg(C.min_index(x, i).alias("lo"), C.max_index(x, i).alias("hi"))


# -- sets and bags


@query("select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def distinct_first(spark, d):
    return orders(spark, d, "o_custkey").distinct().df.select("o_orderkey", "o_custkey")


@query("select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 4")
def distinct_at_least(spark, d):
    return orders(spark, d, "o_custkey").distinct(at_least=4).df.select("o_orderkey", "o_custkey")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id, substr(event_type, 1, 1) order by event_id) = 1")
def distinct_by_key(spark, d):
    return events(spark, d).distinct(lambda x: F.substring(x, 1, 1)).df.select("user_id", "event_id", "event_type")


@query("select name, row_number() over (order by s, k) - 1 as at from (select 0 as s, r_regionkey as k, r_name as name from region union all select 1, n_nationkey, n_name from nation union all select 2, c_custkey, c_name from customer)")
def append(spark, d):
    region, nation, customer = (Seq(table(spark, d, t), c, ORDERS[t]) for t, c in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name")))
    return nation.prepend(region).append(customer).positions("at").df.select(F.col("n_name").alias("name"), "at")


@query("select r_name as name from region")
def if_empty(spark, d):
    none = Seq(table(spark, d, "nation"), "n_name", "n_nationkey").filter(lambda x: F.col("n_nationkey") < 0)
    return none.if_empty(Seq(table(spark, d, "region"), "r_name", "r_regionkey")).df.select(F.col("n_name").alias("name"))


# -- joins


@query("with a as (select c_name, row_number() over (order by c_custkey) as i from customer), b as (select s_name, row_number() over (order by s_suppkey) as i from supplier) select c_name, s_name from a join b using (i)")
def zip_with(spark, d):
    out = Seq(table(spark, d, "customer"), "c_name", "c_custkey").zip_with(Seq(table(spark, d, "supplier"), "s_name", "s_suppkey"))
    return out.df.select(F.col("key").alias("c_name"), F.col("value").alias("s_name"))


@query("select a.n_regionkey, a.n_name as one, b.n_name as two from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def pairs(spark, d):
    return Seq(table(spark, d, "nation"), "n_name", "n_nationkey", "n_regionkey").pairs().df.select("n_regionkey", F.col("key").alias("one"), F.col("value").alias("two"))


@query("select n_name, r_name from nation, region")
def cross(spark, d):
    out = Seq(table(spark, d, "nation"), "n_name", "n_nationkey").cross(Seq(table(spark, d, "region"), "r_name", "r_regionkey"))
    return out.df.select(F.col("key").alias("n_name"), F.col("value").alias("r_name"))


@query("with p as (select n_name, row_number() over (order by n_nationkey) - 1 as i from nation) select s_suppkey, n_name from supplier join p on i = s_suppkey % 30")
def elements(spark, d):
    at = Seq(table(spark, d, "supplier").withColumn("at", F.col("s_suppkey") % 30), "at", "s_suppkey")
    return at.elements(Seq(table(spark, d, "nation"), "n_name", "n_nationkey")).df.select("s_suppkey", F.col("at").alias("n_name"))


# -- aggregation and collectors


@query("select user_id, event_type, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from events group by all")
def grouping_by(spark, d):
    return events(spark, d, "event_id").grouping_by(lambda x: F.col("event_type"), ids=C.joining(",")).withColumnRenamed("key", "event_type")


@query("select k as priority, coalesce(n, 0) as n from (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) as k) left join (select o_orderpriority, count(*) as n from orders group by 1) on k = o_orderpriority")
def grouping_domain(spark, d):
    domain = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
    return orders(spark, d, "o_orderpriority").grouping_by_domain(lambda x: x, domain, {"n": 0}, n=C.counting).withColumnRenamed("key", "priority")


@query("select u.user_id, f.side, count(e.event_id) as n from (select distinct user_id from events) u cross join (select unnest([true, false]) as side) f left join events e on e.user_id = u.user_id and (e.event_type = 'purchase') = f.side group by all")
def partitioning_by(spark, d):
    out = events(spark, d).partitioning_by(lambda x: x == "purchase", n=lambda x, at: F.count(x))
    return out.withColumnRenamed("key", "side")


@query("select o_custkey, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n, count(distinct o_orderstatus) as kinds, case when count(*) = 1 then min(o_orderkey) end as only, case when bool_and(o_totalprice > 1000) then count(*) end as rich, count(*) filter (o_orderstatus = 'F') as filled, max(o_orderkey) - min(o_orderkey) as spread from orders group by o_custkey")
def collectors(spark, d):
    s = lambda x: F.col("o_orderstatus")
    return orders(spark, d, "o_orderkey", ["o_custkey"]).collect(
        first=C.first, last=C.last, n=C.counting, kinds=C.mapping(s, C.distinct_count), only=C.only_one,
        rich=C.if_all_match(lambda x: F.col("o_totalprice") > 1000, C.counting), filled=C.count_if(lambda x: s(x) == "F"), spread=C.min_max(lambda lo, hi: hi - lo),
    )


@query("select user_id, array_to_string(list(event_id order by event_id)[1:3], ',') as head, array_to_string(list(event_id order by event_id)[-3:], ',') as tail from events group by user_id")
def head_tail(spark, d):
    text = lambda c: C.and_then(c, lambda a: F.array_join(a.cast("array<string>"), ","))
    return events(spark, d, "event_id").collect(head=text(C.head(3)), tail=text(C.tail(3)))


@query("select user_id, bool_or(event_type = 'purchase') as any_buy, bool_and(event_type <> 'purchase') as none_buy, bool_and(event_id > 0) as all_ids from events group by user_id")
def matches(spark, d):
    seq = events(spark, d)
    one = seq.any_match(lambda x: x == "purchase").withColumnRenamed("matches", "any_buy")
    two = seq.none_match(lambda x: x == "purchase").withColumnRenamed("matches", "none_buy")
    three = seq.all_match(lambda x: F.col("event_id") > 0).withColumnRenamed("matches", "all_ids")
    return one.join(two, "user_id").join(three, "user_id")


@query("with p as (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) select user_id, min(i) filter (event_type = 'purchase') as index from p group by user_id")
def index_of(spark, d):
    return events(spark, d).index_of(lambda x: x == "purchase")


@query("select user_id, min(event_id) as event_id from events where event_type = 'click' group by user_id")
def find_first(spark, d):
    return events(spark, d, "event_id").find_first(lambda x: F.col("event_type") == "click")


@query("select o_custkey, cast(case when (s % 4294967296 + 4294967296) % 4294967296 >= 2147483648 then (s % 4294967296 + 4294967296) % 4294967296 - 4294967296 else (s % 4294967296 + 4294967296) % 4294967296 end as integer) as total, s::bigint as whole, b as bits from (select o_custkey, sum(cast(o_orderkey * 1000003 as hugeint)) as s, bit_and(o_orderkey) as b from orders group by 1)")
def wrapping_sums(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(N.sum_int(x * 1000003).alias("total"), N.sum_long(x * 1000003).alias("whole"), C.bit_and(x).alias("bits"))


@query("select n_regionkey, (select max(substr(lo, 1, k)) from (select unnest(range(0, 30)) as k) where substr(lo, 1, k) = substr(hi, 1, k) and k <= length(lo)) as common from (select c_nationkey % 5 as n_regionkey, min(c_name) as lo, max(c_name) as hi from customer group by 1)")
def common_prefix(spark, d):
    return table(spark, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("n_regionkey")).agg(C.common_prefix(F.col("c_name")).alias("common"))


@query("select user_id % 10 as g, string_agg(event_type, ',' order by event_type) as types from (select user_id % 10 as g2, event_type, count(distinct user_id) as n from events group by 1, 2) t join (select user_id % 10 as g3, count(distinct user_id) as m from events group by 1) u on g2 = g3 and n = m cross join (select 0 as user_id) z where false group by 1 union all select g2, string_agg(event_type, ',' order by event_type) from (select user_id % 10 as g2, event_type, count(distinct user_id) as n from events group by 1, 2) t join (select user_id % 10 as g3, count(distinct user_id) as m from events group by 1) u on g2 = g3 and n = m group by 1")
def intersecting(spark, d):
    own = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    out = own.groupBy((F.col("user_id") % 10).alias("g")).agg(F.array_join(F.array_sort(C.intersecting(F.col("types"), F.col("user_id"))), ",").alias("types"))
    return out.where("types <> ''")


@query("select conv_id, string_agg(role, '|' order by turn) as roles, case when count(*) > 2 then array_to_string(list(role order by turn)[1:2], ', ') || ', ...' else string_agg(role, ', ' order by turn) end as bounded from conversations group by conv_id")
def joining(spark, d):
    seq = Seq(table(spark, d, "conversations"), "role", "turn", "conv_id")
    return seq.collect(roles=C.joining("|"), bounded=Joining(", ").max_elements(2))


@query(f"with {_E} select user_id, list_reduce(list_prepend(cast(7 as bigint), list(amount order by event_id)), lambda a, x: (a * 31 + x) % 1000003) as amount from e group by user_id")
def fold_left(spark, d):
    return events(spark, d, "amount").fold_left(F.lit(7).cast("bigint"), lambda acc, x: (acc * 31 + x) % 1000003)


@query(f"with {_E} select user_id, list_reduce(list_prepend(cast(7 as bigint), list(amount order by event_id desc)), lambda a, x: (a * 31 + x) % 1000003) as amount from e group by user_id")
def fold_right(spark, d):
    return events(spark, d, "amount").fold_right(F.lit(7).cast("bigint"), lambda x, acc: (acc * 31 + x) % 1000003)


# -- pairs


@query("select c_nationkey as key, c_mktsegment as value, count(*) as n from customer where c_mktsegment <> 'BUILDING' and c_nationkey is not null group by all")
def pairs_invert(spark, d):
    own = Pairs(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_custkey").without_keys("BUILDING").non_null_values().invert()
    return own.df.groupBy(own.k.alias("key"), own.v.alias("value")).agg(F.count("*").alias("n"))


@query("select user_id, string_agg(t || '=' || n, ';' order by t) as counts from (select user_id, event_type as t, cast(count(*) as varchar) as n from events group by all) group by user_id")
def to_map(spark, d):
    own = Pairs(table(spark, d, "events"), "event_type", "event_id", "event_id", "user_id").to_sorted_map(lambda values: F.size(values))
    return own.select("user_id", F.array_join(F.transform("map", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("counts"))


@query("select n_nationkey, unnest(list_filter(string_split(n_name, ''), lambda x: x <> '')) as letter, n_regionkey as key from nation")
def flat_map_values(spark, d):
    own = Pairs(table(spark, d, "nation"), "n_regionkey", "n_name", "n_nationkey").flat_map_values(lambda v: F.filter(F.split(v, ""), lambda c: c != ""))
    return own.df.select("n_nationkey", F.col("n_name").alias("letter"), F.col("n_regionkey").alias("key"))


@query("select n_nationkey, '[' || n_regionkey || ':' || n_name || ']' as text from nation where n_regionkey > 1")
def pairs_join(spark, d):
    own = Pairs(table(spark, d, "nation"), "n_regionkey", "n_name", "n_nationkey").filter_keys(lambda k: k > 1).join(":", "[", "]")
    return own.df.select("n_nationkey", F.col("value").alias("text"))


@query("select c_nationkey, c_custkey from customer qualify row_number() over (partition by c_nationkey order by c_custkey) = 1")
def distinct_keys(spark, d):
    return Pairs(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_custkey").distinct_keys().df.select("c_nationkey", "c_custkey")


# -- sources


@query("select array_to_string(w, ',') as value, i as at from (select i, [c.n_nationkey for c in l][i * 3 + 1:i * 3 + 5] as w from (select list(nation order by n_nationkey) as l from nation), range(0, 8) t(i))")
def sub_lists(spark, d):
    seq = S.sub_lists(Seq(table(spark, d, "nation"), "n_nationkey", "n_nationkey"), 5, 3)
    return seq.df.select(F.array_join(F.col("n_nationkey").cast("array<string>"), ",").alias("value"), F.col("_window").cast("bigint").alias("at"))


@query("select a.n_nationkey || '-' || b.n_nationkey || '-' || c.n_nationkey as value from nation a, nation b, nation c where a.n_nationkey < b.n_nationkey and b.n_nationkey < c.n_nationkey and c.n_nationkey < 8")
def combinations(spark, d):
    return S.combinations(spark, 8, 3).df.select(F.array_join(F.col("value").cast("array<string>"), "-").alias("value"))


@query("select a.k || '' || b.k || '' || c.k as value from range(0, 3) a(k), range(0, 3) b(k), range(0, 3) c(k) where a.k <> b.k and b.k <> c.k and a.k <> c.k")
def permutations(spark, d):
    return S.permutations(spark, 3).df.select(F.array_join(F.col("value").cast("array<string>"), "").alias("value"))


@query("select a || b as value from (select unnest(['x', 'y']) as a), (select unnest(['1', '2', '3']) as b)")
def cartesian_product(spark, d):
    return S.cartesian_product(spark, [["x", "y"], ["1", "2", "3"]], "string").df.select(F.array_join("value", "").alias("value"))


@query("select row_number() over (order by r_regionkey, coalesce(n_nationkey, -1)) - 1 as at, coalesce(n_name, r_name) as name, case when n_name is null then 0 else 1 end as depth from (select r_regionkey, r_name, null as n_nationkey, null as n_name from region union all select r_regionkey, r_name, n_nationkey, n_name from region join nation on n_regionkey = r_regionkey)")
def tree(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("rank"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name"))
    seq = S.tree(regions.unionByName(nations), "id", "parent", "rank", ["name"])
    return seq.positions("at").df.select("at", "name", "depth")


@query("select doc_id, count(*) as parts, sum(length(w))::bigint as chars from (select doc_id, unnest(string_split(rtrim(text, 'e'), 'e')) as w from documents) group by doc_id")
def split(spark, d):
    return S.split(table(spark, d, "documents"), "text", "e", ["doc_id"]).df.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query("select n_nationkey, cast(k - 1 as bigint) as at, cast(unicode(c) as integer) as value from (select n_nationkey, unnest(list_filter(string_split(n_name, ''), lambda x: x <> '')) as c, generate_subscripts(list_filter(string_split(n_name, ''), lambda x: x <> ''), 1) as k from nation)")
def code_points(spark, d):
    return S.code_points(table(spark, d, "nation"), "n_name", ["n_nationkey"]).df.select("n_nationkey", F.col("_pos").cast("bigint").alias("at"), "value")


@query("with recursive t(value, k) as (select 27::bigint, 0::bigint union all select case when value % 2 = 0 then value // 2 else 3 * value + 1 end, k + 1 from t where value <> 1) select value, k as at from t")
def emitter(spark, d):
    return S.emit("collatz", 27, 1000).df.select("value", F.col("_pos").alias("at"))


@query("select cast(value as bigint) as value, row_number() over () - 1 as at from (select unnest(range(10, -11, -3)) as value)")
def ranges(spark, d):
    return S.range_(spark, 10, -11, -3).positions("at").df.select("value", "at")


# -- pairs, one by one


def order_pairs(spark: SparkSession, d: str) -> Pairs:
    """Orders as pairs of customer and price in cents."""
    df = table(spark, d, "orders").withColumn("cents", F.floor("o_totalprice"))
    return Pairs(df.withColumn("cust", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))), "cust", "cents", "o_orderkey")


_P = "p as (select o_orderkey, case when o_custkey % 5 <> 0 then o_custkey end as cust, cast(floor(o_totalprice) as bigint) as cents from orders)"


@query(f"with {_P} select o_orderkey, cust, cents from p where cust is not null and cents > 1000 and not (cust > 100 and cents > 200000) and cust + cents > 5000 and cents % 2 = 0 and cents not in (40000, 50000)")
def pairs_filters(spark, d):
    found = order_pairs(spark, d).non_null_keys().filter_values(lambda v: v > 1000).remove_key_value(lambda k, v: (k > 100) & (v > 200000))
    found = found.filter_key_value(lambda k, v: k + v > 5000).remove_values(lambda v: v % 2 == 1).without_values(40000, 50000)
    return found.df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, cust, cents from p where cust is null or cust <= 50")
def pairs_remove_keys(spark, d):
    return order_pairs(spark, d).remove_keys(lambda k: k > 50).df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, (cust + 1) * 3 + (cents * 2 - 7) as cust, (cents * 2 - 7) - ((cust + 1) * 3 + (cents * 2 - 7)) as cents from p where cust is not null")
def pairs_maps(spark, d):
    found = order_pairs(spark, d).map_keys(lambda k: k + 1).map_values(lambda v: v * 2 - 7).map_to_key(lambda k, v: k * 3 + v).map_to_value(lambda k, v: v - k)
    return found.non_null_keys().df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, cust * 2 as cust, cents - 5000 as cents from p where cust > 30 and cents > 5000 and cust * 2 + cents % 10 <> 61 and cents % 3 <> 0")
def pairs_partial_maps(spark, d):
    found = order_pairs(spark, d).map_keys_partial(lambda k: F.when(k > 30, k)).map_values_partial(lambda v: F.when(v > 5000, v))
    found = found.map_to_key_partial(lambda k, v: F.when(k * 2 + v % 10 != 61, k * 2)).map_to_value_partial(lambda k, v: F.when(v % 3 != 0, v - 5000))
    return found.df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, cents as pair from p union all select o_orderkey, cust + cents as pair from p where cust is not null")
def pairs_to_values(spark, d):
    pairs = order_pairs(spark, d)
    one, two = pairs.values().df.select("o_orderkey", F.col("cents").alias("pair")), pairs.map_key_value_partial(lambda k, v: k + v, "pair").df.select("o_orderkey", "pair")
    return one.unionByName(two)


@query(f"with {_P} select o_orderkey, cast(unnest([0, 1]) as bigint) as sub, unnest([cust, cust + 1]) as cust, cents from p where cust < 40")
def pairs_flat_map_keys(spark, d):
    found = order_pairs(spark, d).filter_keys(lambda k: k < 40).flat_map_keys(lambda k: F.array(k, k + 1))
    return found.df.select("o_orderkey", F.col("_sub1").cast("bigint").alias("sub"), "cust", "cents")


@query(f"with {_P} select o_orderkey, cust, unnest([cents, cents + cust]) as cents from p where cust < 40")
def pairs_flat_map_to_value(spark, d):
    return order_pairs(spark, d).filter_keys(lambda k: k < 40).flat_map_to_value(lambda k, v: F.array(v, v + k)).df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, unnest([cust, cents]) as cust, cents from p where cust < 40")
def pairs_flat_map_to_key(spark, d):
    return order_pairs(spark, d).filter_keys(lambda k: k < 40).flat_map_to_key(lambda k, v: F.array(k, v)).df.select("o_orderkey", "cust", "cents")


@query(f"with {_P} select o_orderkey, unnest([cust, cents]) as flat from p where cust < 40")
def pairs_flat_map_key_value(spark, d):
    found = order_pairs(spark, d).filter_keys(lambda k: k < 40).flat_map_key_value(lambda k, v: F.array(k, v))
    return found.df.select("o_orderkey", F.col(found.value).alias("flat"))


@query(f"with {_P} select cust, array_to_string(list(cents order by o_orderkey), ',') as cents from p where cust is not null group by cust")
def pairs_grouping(spark, d):
    return order_pairs(spark, d).grouping().select("cust", F.array_join("cents", ",").alias("cents"))


@query(f"with {_P} select min(o_orderkey) as o_orderkey, cents from p group by cents")
def pairs_distinct_values(spark, d):
    return order_pairs(spark, d).distinct_values().df.select("o_orderkey", "cents")


@query(f"with {_P} select bool_or(cust > 90 and cents > 1000) as any_match, bool_and(coalesce(cust > 0, false)) as all_match, not bool_or(cents < 0) as none_match from p")
def pairs_matches(spark, d):
    pairs = order_pairs(spark, d)
    one, two, three = pairs.any_match(lambda k, v: (k > 90) & (v > 1000)), pairs.all_match(lambda k, v: k > 0), pairs.none_match(lambda k, v: v < 0)
    return one.toDF("any_match").crossJoin(two.toDF("all_match")).crossJoin(three.toDF("none_match"))


@query("select o_custkey, sum(cast(floor(o_totalprice) as bigint)) over w as cust_sum, max(cast(floor(o_totalprice) as bigint)) over w as cust_max from orders window w as (partition by o_custkey order by o_orderkey)")
def pairs_prefix(spark, d):
    df = table(spark, d, "orders").withColumn("cust_sum", F.floor("o_totalprice")).withColumn("cust_max", F.floor("o_totalprice"))
    return Pairs(df, "cust_sum", "cust_max", "o_orderkey", "o_custkey").prefix_keys("sum").prefix_values("max").df.select("o_custkey", "cust_sum", "cust_max")


# -- literal rows: nulls, both zeros, large numbers, empty sides


def literal(spark: SparkSession, rows: list[tuple], kind: str) -> Seq:
    """Rows (key, place, value) as one sequence for each key, a null key included."""
    return Seq(spark.createDataFrame(rows, f"k int, i int, x {kind}"), "x", "i", "k")


_ROWS = [(1, 0, 5), (1, 1, 1), (1, 2, 7), (1, 3, None), (None, 0, 3), (None, 1, 9), (2, 0, 2)]
_VALUES = "v(k, i, x) as (values (1, 0, 5), (1, 1, 1), (1, 2, 7), (1, 3, null), (null, 0, 3), (null, 1, 9), (2, 0, 2))"


@query(f"with {_VALUES} select k, count(*) filter (x > 4) as n, coalesce(array_to_string(list(x order by i) filter (x > 4), ','), '') as list, min(x) filter (x > 4) as least from v group by k")
def filtering(spark, d):
    p = lambda x: x > 4
    found = literal(spark, _ROWS, "int").collect(n=C.filtering(p, C.counting), list=C.filtering(p, C.to_list), least=C.filtering(p, lambda x, at: F.min(x)))
    return found.withColumn("list", F.array_join("list", ","))


@query(f"with {_VALUES}, s as (select distinct k, unnest([true, false]) as key from v) select s.k, s.key, coalesce(array_to_string(list(x order by i) filter (i is not null), ','), '') as x, count(i) as n from s left join v on v.k is not distinct from s.k and coalesce(v.x > 4, false) = s.key group by all")
def partitioning_by_sides(spark, d):
    found = literal(spark, _ROWS, "int").partitioning_by(lambda x: x > 4, x=C.to_list, n=C.counting)
    return found.withColumn("x", F.array_join("x", ","))


@query("select * from (values (1, cast(0.5 as double)), (2, cast(4611686018427387904 as double))) t(k, average)")
def average_long(spark, d):
    rows = [(1, 0, 2**53 + 1), (1, 1, -(2**53)), (2, 0, 2**62), (2, 1, 2**62)]
    return literal(spark, rows, "bigint").average()


@query("select k, list_position(o, i) - 1 as at, i from (select unnest([1, 1, 1, 1, 1]) as k, unnest([4, 1, 0, 3, 2]) as i, [4, 1, 0, 3, 2] as o)")
def sorted_doubles(spark, d):
    rows = [(1, 0, 0.0), (1, 1, -0.0), (1, 2, float("nan")), (1, 3, 2.5), (1, 4, -1.0)]
    return literal(spark, rows, "double").sorted().positions("at").df.select("k", F.col("at").cast("bigint").alias("at"), "i")


@query("select k, list_position(o, i) - 1 as at, i from (select unnest([1, 1, 1, 1, 1]) as k, unnest([2, 3, 0, 1, 4]) as i, [2, 3, 0, 1, 4] as o)")
def reverse_sorted_doubles(spark, d):
    rows = [(1, 0, 0.0), (1, 1, -0.0), (1, 2, float("nan")), (1, 3, 2.5), (1, 4, -1.0)]
    return literal(spark, rows, "double").reverse_sorted().positions("at").df.select("k", F.col("at").cast("bigint").alias("at"), "i")


@query(f"with {_VALUES}, r as (select *, row_number() over (partition by k order by x desc, i) - 1 as place from v where x is not null) select k, place, x from r")
def reverse_sorted_null_key(spark, d):
    return literal(spark, _ROWS, "int").non_null().reverse_sorted().positions("place").df.select("k", F.col("place").cast("bigint").alias("place"), "x")


@query(f"with {_VALUES}, r as (select *, row_number() over (partition by k order by i) as a, row_number() over (partition by k order by i desc) as b from v) select r.k, r.x as key, s.x as value from r join r s on r.k is not distinct from s.k and r.a = s.b")
def zip_reversed_null_key(spark, d):
    seq = literal(spark, _ROWS, "int")
    return seq.zip(seq.reverse()).df.select("k", "key", "value")


@query(f"with {_VALUES} select k, count(x) as count, cast(coalesce(sum(x), 0) as bigint) as sum, min(x) as min, max(x) as max, avg(x) as average from v group by k")
def summary_statistics(spark, d):
    return literal(spark, _ROWS, "int").summary_statistics()


@query(f"with {_VALUES} select k, i, x from v where (x <> 7 or x is null) and x is not null")
def remove_by_non_null(spark, d):
    return literal(spark, _ROWS, "int").remove_by(lambda x: x, 7).non_null().df


@query(f"with {_VALUES} select k, bool_or(x is not distinct from 9) as has, count(*) as n, cast(coalesce(sum(x), 0) as bigint) as sum, min(x) as min, max(x) as max, arg_min(x, i) filter (x > 2) as first from v group by k")
def single_results(spark, d):
    seq = literal(spark, _ROWS, "int")
    both = seq.df.select("k").distinct()
    for part in (seq.has(9).withColumnRenamed("matches", "has"), seq.count(), seq.sum().withColumn("sum", F.col("sum").cast("bigint")), seq.min(), seq.max(), seq.find_first(lambda x: x > 2).withColumnRenamed("x", "first")):
        both = join_keys(both, part, ["k"], "left", ["k"])
    return both


@query("select c_nationkey, min(c_acctbal) as min, max(c_acctbal) as max, cast(count(*) as bigint) as n from customer group by c_nationkey")
def min_max_count(spark, d):
    seq = Seq(table(spark, d, "customer"), "c_acctbal", "c_custkey", "c_nationkey")
    return seq.min().join(seq.max(), "c_nationkey").join(seq.count(), "c_nationkey")


@query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) - 1 as bigint) as at from orders")
def sorted_by_key(spark, d):
    found = orders(spark, d, "o_orderkey", ["o_custkey"]).sorted_by(lambda x: F.col("o_totalprice"))
    return found.positions("at").df.select("o_custkey", "o_orderkey", F.col("at").cast("bigint").alias("at"))


@query("select o_custkey, cast(wrap as bigint) as wrap from (select o_custkey, list_reduce(list(cast(floor(o_totalprice) as bigint) order by o_orderkey), lambda a, x: (a * 31 + x) % 1000003) as wrap from orders group by o_custkey)")
def reduce_any(spark, d):
    return orders(spark, d, "cents", ["o_custkey"]).reduce(lambda a, x: (a * 31 + x) % 1000003).select("o_custkey", F.col("cents").alias("wrap"))


@query("select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as types from events group by user_id")
def to_set(spark, d):
    return events(spark, d).collect(types=C.to_set).withColumn("types", F.array_join("types", ","))


@query("select conv_id, reverse(suffix) as suffix from (select conv_id, max(len) as n, arg_max(pre, len) as suffix from (select conv_id, len, left(lo, len) as pre from (select conv_id, min(reverse(role)) as lo, max(reverse(role)) as hi from conversations group by conv_id), range(0, 20) t(len) where len <= least(length(lo), length(hi)) and left(lo, len) = left(hi, len)) group by conv_id)")
def common_suffix(spark, d):
    return Seq(table(spark, d, "conversations"), "role", "turn", "conv_id").collect(suffix=C.common_suffix)


# -- bounded joining: cuts and units

_NUMBERS = "'one, two, three, four, five, six, seven, eight, nine, ten'"


@query(f"select cut, left(t, n) || '...' as joined from (select {_NUMBERS} as t, unnest(['anywhere', 'code_point', 'grapheme', 'word', 'before', 'after', 'default']) as cut, unnest([13, 13, 13, 10, 8, 10, 13]) as n)")
def joining_cuts(spark, d):
    words = "one two three four five six seven eight nine ten".split()
    rows = Seq(spark.createDataFrame(list(enumerate(words)), "i int, x string"), "x", "i")
    j = Joining(", ").max_chars(16)
    cuts = {"anywhere": j.cut_anywhere(), "code_point": j.cut_at_code_point(), "grapheme": j.cut_at_grapheme(), "word": j.cut_at_word(), "before": j.cut_before_delimiter(), "after": j.cut_after_delimiter(), "default": j}
    found = rows.collect(**cuts)
    return found.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cuts)), F.array(*cuts))).alias("cut", "joined"))


@query("select '[one, two, ...]' as elements, '<[one, tw..]>' as wrapped, 'one, two, three, f~' as points, 'one, two, thr~' as graphemes")
def joining_units(spark, d):
    words = "one two three four five six seven eight nine ten".split()
    rows = Seq(spark.createDataFrame(list(enumerate(words)), "i int, x string"), "x", "i")
    j = Joining(", ", "[", "]")
    return rows.collect(
        elements=j.max_elements(2), wrapped=j.wrap("<", ">").max_chars(13).with_ellipsis("..").cut_anywhere(),
        points=Joining(", ").max_code_points(19).with_ellipsis("~").cut_anywhere(), graphemes=Joining(", ").max_graphemes(14).with_ellipsis("~").cut_anywhere(),
    )


# -- sources and narrowings


@query("select cast(i as bigint) as at, cast(7 as bigint) as value, 'constant' as name from range(5) t(i) union all select i, i, 'longs' from range(6) t(i) union all select i, i * i, 'generate' from range(5) t(i) union all select i, cast(2 ** i as bigint), 'iterate' from range(7) t(i)")
def simple_sources(spark, d):
    out = None
    for name, seq in (("constant", S.constant(spark, 7, 5)), ("longs", S.longs(spark, 6)), ("generate", S.generate(spark, 5, lambda i: i * i)), ("iterate", S.iterate(spark, 1, "value * 2", "bigint", "value <= 64"))):
        rows = seq.positions("at").df.select(F.col("at").cast("bigint").alias("at"), seq.x.cast("bigint").alias("value"), F.lit(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select name, cast(k as bigint) as key, value from (values ('map', 1, 'a'), ('map', 2, 'b'), ('pairs', 1, 'x'), ('pairs', 1, 'y'), ('list', 0, 'p'), ('list', 1, 'q'), ('one', 0, 'z')) t(name, k, value)")
def value_sources(spark, d):
    found = (("map", S.of_map(spark, {1: "a", 2: "b"}, "int", "string")), ("pairs", S.of_pairs(spark, [(1, "x"), (1, "y")], "int", "string")), ("list", S.of_list(spark, ["p", "q"], "string")))
    out = None
    for name, pairs in found:
        rows = pairs.df.select(F.lit(name).alias("name"), pairs.k.cast("bigint").alias("key"), pairs.v.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    one = S.of_nullable(spark, "z", "string").append(S.of_nullable(spark, None, "string"), S.empty(spark, "string"))
    return out.unionByName(one.df.select(F.lit("one").alias("name"), F.lit(0).cast("bigint").alias("key"), one.x.alias("value")))


@query("select doc_id, cast(k - 1 as bigint) as at, ascii(substr(source, k, 1)) as code from (select doc_id, source, unnest(range(1, length(source) + 1)) as k from documents)")
def chars_of_text(spark, d):
    seq = S.chars(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return seq.positions("at").df.select("doc_id", F.col("at").cast("bigint").alias("at"), F.ascii(seq.x).alias("code") if dict(seq.df.dtypes)[seq.value] == "string" else seq.x.cast("int").alias("code"))


@query("select o_orderkey, cast(floor(o_totalprice) as integer) as i, cast(floor(o_totalprice) as double) / 2 as f from orders")
def typed_maps(spark, d):
    seq = orders(spark, d, "cents")
    one = seq.map_to_int().df.select("o_orderkey", F.col("cents").alias("i"))
    return one.join(seq.map_to_double(lambda x: x / 2).df.select("o_orderkey", F.col("cents").alias("f")), "o_orderkey")


@query("select user_id, event_id, case when row_number() over w = 1 then event_type || '!' else event_type || '?' end as event_type from events window w as (partition by user_id order by event_id)")
def map_first_or_else(spark, d):
    return events(spark, d).map_first_or_else(lambda x: F.concat(x, F.lit("!")), lambda x: F.concat(x, F.lit("?"))).df.select("user_id", "event_id", "event_type")


@query("select user_id, event_id, case when row_number() over w = 1 then event_type || '!' else event_type || '?' end as event_type from events window w as (partition by user_id order by event_id desc)")
def map_last_or_else(spark, d):
    return events(spark, d).map_last_or_else(lambda x: F.concat(x, F.lit("?")), lambda x: F.concat(x, F.lit("!"))).df.select("user_id", "event_id", "event_type")


@query("select c_custkey, seg as key, cast(n as bigint) as value from (select c_custkey, unnest([c_mktsegment, 'all']) as seg, unnest([1, 2]) as n from customer)")
def flat_map_to_entry(spark, d):
    seq = Seq(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    found = seq.flat_map_to_entry(lambda x: F.create_map(x, F.lit(1), F.lit("all"), F.lit(2)))
    return found.df.select("c_custkey", "key", F.col("value").cast("bigint").alias("value"))


@query("select p_partkey, p_brand as key, p_size as value from part where p_size > 10")
def map_to_entry_partial(spark, d):
    seq = Seq(table(spark, d, "part"), "p_size", "p_partkey")
    return seq.map_to_entry_partial(lambda x: F.col("p_brand"), lambda x: F.when(x > 10, x)).df.select("p_partkey", "key", "value")


@query("select n_nationkey, cast(row_number() over (order by n_nationkey desc) - 1 as bigint) as at from nation")
def reverse(spark, d):
    return Seq(table(spark, d, "nation"), "n_name", "n_nationkey").reverse().positions("at").df.select("n_nationkey", F.col("at").cast("bigint").alias("at"))
