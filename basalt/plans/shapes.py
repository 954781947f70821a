"""Shapes of further workloads on the tables that are there: integer dates, roll-ups with ranks, channels, frames, and fixtures of joins and nulls.

Sums of money are made in whole cents, or rounded where the shape wants floating point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import aggregate as A
from ..functions import scalar as X
from ..operators import aggregate, join, order
from ..registry import frames, op, sql
from ..sources import files

# --- fixtures -------------------------------------------------------------------------------------

# Two small tables of exercises and of nulls.
_CROSSFIT = "crossfit AS (SELECT * FROM (VALUES ('Push Ups', 3), ('Pull Ups', 5), ('Push Jerk', 5), ('Bar Muscle Up', 10), ('a', 10), ('b', 13), ('c', 15), ('d', 16)) AS t(exercise, difficulty_level))"
_EQUIPMENT = "equipment AS (SELECT * FROM (VALUES ('Board', 3), ('Weight', 5), ('Trampoline', 3), ('Horse', 12)) AS t(equip, difficulty_level))"
_T = "t AS (SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES (3, 1), (NULL, 2), (3, 3), (NULL, 4), (2, 5)) AS v(a, b))"
_S = "s AS (SELECT CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d FROM (VALUES (NULL, 1), (NULL, 2), (NULL, 3), (NULL, 4), (NULL, 5)) AS v(c, d))"

_ON = "crossfit.difficulty_level = equipment.difficulty_level"
_BOTH = "exercise, crossfit.difficulty_level AS level, equip, equipment.difficulty_level AS equip_level"
for _name, _text in {
    "left": f"SELECT {_BOTH} FROM crossfit LEFT OUTER JOIN equipment ON {_ON}",
    "right": f"SELECT {_BOTH} FROM crossfit RIGHT OUTER JOIN equipment ON {_ON}",
    "semi": f"SELECT * FROM crossfit {{}} SEMI JOIN equipment ON {_ON}",
    "semi_reversed": f"SELECT * FROM equipment {{}} SEMI JOIN crossfit ON {_ON}",
    "anti": f"SELECT * FROM crossfit {{}} ANTI JOIN equipment ON {_ON}",
    "anti_reversed": f"SELECT * FROM equipment {{}} ANTI JOIN crossfit ON {_ON}",
}.items():
    sql(f"fixture_join_{_name}", f"WITH {_CROSSFIT}, {_EQUIPMENT} {_text.replace('{}', 'LEFT')}", f"WITH {_CROSSFIT}, {_EQUIPMENT} {_text.replace('{} ', '')}")
for _name, _text in {
    "equal": "SELECT a FROM t WHERE a = 3",
    "equal_null": "SELECT a FROM t WHERE a = NULL",
    "is_not_null": "SELECT a FROM t WHERE a IS NOT NULL",
    "is_null": "SELECT a FROM t WHERE a IS NULL",
    "count": "SELECT count(a) AS n FROM t",
    "count_star": "SELECT count(*) AS n FROM t",
    "sum": "SELECT CAST(sum(a) AS BIGINT) AS n FROM t",
    "group_sum": "SELECT a, CAST(sum(b) AS BIGINT) AS n FROM t GROUP BY a",
    "group_count_star": "SELECT a, count(*) AS n FROM t GROUP BY a",
    "group_count": "SELECT a, count(a) AS n FROM t GROUP BY a",
    "sum_of_nulls": "SELECT CAST(sum(c) AS BIGINT) AS n FROM s",
}.items():
    sql(f"fixture_null_{_name}", f"WITH {_T}, {_S} {_text}")

# --- where the engine's own operators meet nulls, line feeds and hot keys -------------------------

_GROUPS = "(VALUES (1, 2), (1, 2), (1, NULL), (NULL, 3), (NULL, 4), (NULL, NULL), (2, NULL)) AS t(g, v)"


@op("agg_count_distinct_null_group", f"SELECT g, count(DISTINCT v) AS n FROM {_GROUPS} GROUP BY g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_distinct_by(spark.sql(f"SELECT * FROM {_GROUPS}"), ["g"], ["v"], "n")


_LINES = "(SELECT page_id, url || chr(10) || 'b' || url || chr(10) AS x FROM pages) p"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit("\nb"), "url", F.lit("\n")).alias("x"))


_PATTERNS = {"line_feed": ("p.b", "<>"), "alternation": ("e|(x)a", r"[\1]"), "whole_match": ("[aeiou]+", r"<\0>"), "end": ("[0-9]+$", "#"), "digits": ("([a-z])([a-z])", r"\21\1"), "dollar": ("t+", "$1")}
for _name, (_pattern, _new) in _PATTERNS.items():

    @op(f"fn_regexp_replace_{_name}", f"SELECT page_id, regexp_replace(x, '{_pattern}', '{_new}') AS one, regexp_replace(x, '{_pattern}', '{_new}', 'g') AS every FROM {_LINES}")
    def _(spark: SparkSession, sf_dir: str, pattern: str = _pattern, new: str = _new) -> DataFrame:
        return _lines(spark, sf_dir).select("page_id", X.regexp_replace(F.col("x"), pattern, new).alias("one"), X.regexp_replace(F.col("x"), pattern, new, True).alias("every"))


@op("fn_like_line_feed", f"SELECT page_id, x LIKE '%/' AS a, x LIKE 'http%' AS b, x LIKE '%_b%' AS c, x || chr(92) LIKE '%\\' AS d FROM {_LINES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _lines(spark, sf_dir).select("page_id", X.like(x, "%/").alias("a"), X.like(x, "http%").alias("b"), X.like(x, "%_b%").alias("c"), X.like(F.concat(x, F.lit("\\")), "%\\").alias("d"))


@frames("fn_substring_negative", "SELECT p_partkey, substring(p_name, 5, -3) AS a, substring(p_name, -2, -4) AS b, substring(p_name, -100, 97) AS c, substring(p_name, 0, -1) AS d FROM part")
def _(part: DataFrame) -> DataFrame:
    name = F.col("p_name")
    return part.select("p_partkey", X.substring(name, 5, -3).alias("a"), X.substring(name, -2, -4).alias("b"), X.substring(name, -100, 97).alias("c"), X.substring(name, 0, -1).alias("d"))


sql("fn_try", "SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS i, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS d FROM orders")


@frames("fn_row", "SELECT n_nationkey, to_json(struct_pack(col1 := n_regionkey, col2 := n_name))::VARCHAR AS r FROM nation")
def _(nation: DataFrame) -> DataFrame:
    return nation.select("n_nationkey", F.to_json(X.row(F.col("n_regionkey"), F.col("n_name"))).alias("r"))


for _unit in ("year", "quarter", "month", "week"):

    @frames(f"fn_date_trunc_{_unit}", f"SELECT o_orderkey, CAST(date_trunc('{_unit}', o_orderdate) AS TIMESTAMP) AS v FROM orders")
    def _(orders: DataFrame, unit: str = _unit) -> DataFrame:
        return orders.select("o_orderkey", X.date_trunc(unit, F.col("o_orderdate")).alias("v"))


# --- mark joins, and joins with a condition beside the key ----------------------------------------

_LEFT = "(VALUES (1, 1), (1, 2), (2, 2), (NULL, 1), (NULL, NULL), (3, NULL), (4, 4), (9, 9)) AS l(a, b)"
_RIGHT = "(VALUES (1, 1), (1, NULL), (NULL, 2), (3, 3), (4, 4)) AS r(c, d)"


@op("join_mark_null", f"SELECT a, b, a IN (SELECT c FROM {_RIGHT}) AS m FROM {_LEFT}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.mark(spark.sql(f"SELECT * FROM {_LEFT}"), spark.sql(f"SELECT * FROM {_RIGHT}"), [("a", "c")], name="m")


_ROW_IN = "CASE WHEN EXISTS (SELECT 1 FROM {r} WHERE a = c AND b = d) THEN TRUE WHEN EXISTS (SELECT 1 FROM {r} WHERE (a = c OR a IS NULL OR c IS NULL) AND (b = d OR b IS NULL OR d IS NULL)) THEN NULL ELSE FALSE END"


@op("join_mark_multi", f"SELECT a, b, {_ROW_IN.format(r=_RIGHT)} AS m FROM {_LEFT}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.mark(spark.sql(f"SELECT * FROM {_LEFT}"), spark.sql(f"SELECT * FROM {_RIGHT}"), [("a", "c"), ("b", "d")], name="m")


@frames("join_mark_multi_tables", "SELECT l_orderkey, l_linenumber, l_partkey, EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_suppkey AND r.l_linenumber = l.l_linenumber) AS m FROM lineitem l")
def _(lineitem: DataFrame) -> DataFrame:
    right = lineitem.select(F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))
    return join.mark(lineitem, right, [("l_suppkey", "p"), ("l_linenumber", "n")], name="m").select("l_orderkey", "l_linenumber", "l_partkey", "m")


@frames("join_mixed_mark", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > c_acctbal * 40) AS m FROM customer")
def _(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return join.mark(customer, orders, [("c_custkey", "o_custkey")], ("r.o_totalprice", ">", "l.c_acctbal * 40"), "m").select("c_custkey", "m")


_MIXED = "c_custkey = o_custkey AND o_totalprice > c_acctbal * 40"
for _kind, _word in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():

    @frames(f"join_mixed_large_{_kind}", f"SELECT c_custkey, o_orderkey FROM customer {_word} orders ON {_MIXED}")
    def _(customer: DataFrame, orders: DataFrame, kind: str = _kind) -> DataFrame:
        return join.equi(customer, orders, [("c_custkey", "o_custkey")], kind, also=F.expr("o_totalprice > c_acctbal * 40")).select("c_custkey", "o_orderkey")


for _kind, _word in {"semi": "EXISTS", "anti": "NOT EXISTS"}.items():

    @frames(f"join_mixed_large_{_kind}", f"SELECT c_custkey FROM customer WHERE {_word} (SELECT 1 FROM orders WHERE {_MIXED})")
    def _(customer: DataFrame, orders: DataFrame, kind: str = _kind) -> DataFrame:
        return join.equi(customer, orders, [("c_custkey", "o_custkey")], kind, also=F.expr("o_totalprice > c_acctbal * 40")).select("c_custkey")

    @frames(f"join_mixed_large_right_{_kind}", f"SELECT o_orderkey FROM orders WHERE {_word} (SELECT 1 FROM customer WHERE {_MIXED})")
    def _(customer: DataFrame, orders: DataFrame, kind: str = f"right_{_kind}") -> DataFrame:
        return join.equi(customer, orders, [("c_custkey", "o_custkey")], kind, also=F.expr("o_totalprice > c_acctbal * 40")).select("o_orderkey")


_BAND = "p_retailprice / 100 BETWEEN s_acctbal / 100 - 1 AND s_acctbal / 100"
for _kind, _word in {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN"}.items():

    @frames(f"join_theta_large_{_kind}", f"SELECT p_partkey, s_suppkey FROM part {_word} supplier ON {_BAND}")
    def _(part: DataFrame, supplier: DataFrame, kind: str = _kind) -> DataFrame:
        a, b = part.select("p_partkey", "p_retailprice"), supplier.select("s_suppkey", "s_acctbal")
        return join.band(a, b, "p_retailprice / 100", "s_acctbal / 100 - 1", "s_acctbal / 100", kind).select("p_partkey", "s_suppkey")


# --- aggregates, frames, sets, limits -------------------------------------------------------------

sql("agg_grouping", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS gr, CAST(grouping(l_linestatus) AS BIGINT) AS gl, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")


@frames("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(n_name, '-' ORDER BY -n_nationkey) AS back FROM nation GROUP BY n_regionkey")
def _(nation: DataFrame) -> DataFrame:
    name = F.col("n_name")
    return nation.groupBy("n_regionkey").agg(A.string_agg(name, ", ").alias("names"), A.string_agg(name, "-", -F.col("n_nationkey")).alias("back"))


@frames("agg_quantile", "SELECT p_type, quantile_cont(p_size, 0.25) AS q, quantile_cont(p_size, 0.9) AS r FROM part GROUP BY p_type")
def _(part: DataFrame) -> DataFrame:
    return part.groupBy("p_type").agg(A.quantile(F.col("p_size"), 0.25).alias("q"), A.quantile(F.col("p_size"), 0.9).alias("r"))


@frames("agg_approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) > 0 AS close FROM lineitem GROUP BY l_returnflag")
def _(lineitem: DataFrame) -> DataFrame:
    exact = aggregate.count_distinct_by(lineitem, ["l_returnflag"], ["l_orderkey"], "n")
    rough = lineitem.groupBy("l_returnflag").agg(A.approx_count_distinct(F.col("l_orderkey"), 0.01).alias("m"))
    return exact.join(rough, "l_returnflag").select("l_returnflag", (F.abs(F.col("m") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


sql("set_intersect_all", "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 15 INTERSECT ALL SELECT c_nationkey % 5 AS k FROM customer WHERE c_custkey < 9")
sql(
    "window_range_frame",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n, CAST(sum(p_size) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part",
)
sql("window_distribution", "SELECT p_partkey, percent_rank() OVER w AS p, cume_dist() OVER w AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
sql(
    "window_values",
    "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)",
)


@frames("limit_percent", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10%")
def _(customer: DataFrame) -> DataFrame:
    return order.limit_percent(customer.select("c_custkey", "c_acctbal"), 10, "-c_acctbal", "c_custkey")


@frames("topn_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def _(part: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return part.withColumn("k", place).where("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


# --- sources, sinks and functions of Python -------------------------------------------------------


@op("source_jdbc", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written to a database and read back in ranges of its key."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    url = files.save_derby(nation, "nation")
    found = files.read_jdbc(spark, url, "nation", "n_nationkey", (0, 25), tasks=4, driver=files.DERBY)
    return found.select(*[F.col(c).alias(c.lower()) for c in found.columns])


@op("sink_bucketed", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither the join nor the sum moves a row: both tables stand by their key."""
    orders = files.save_bucketed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "basalt_orders", "o_orderkey", 8)
    items = files.save_bucketed(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey"), "basalt_lineitem", "l_orderkey", 8)
    return orders.join(items.hint("merge"), orders.o_orderkey == items.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@op("udf_vectorized", "SELECT o_orderkey, o_totalprice * 2 + 1 AS v FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir, ["orders"])
    engine.register("twice_and_one", lambda x: x * 2 + 1, "double")
    return engine.execute("SELECT o_orderkey, twice_and_one(o_totalprice) AS v FROM orders")


@op("udaf_vectorized", "SELECT o_orderstatus, max(o_custkey) - min(o_custkey) AS v FROM orders GROUP BY o_orderstatus")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir, ["orders"])
    engine.register("width", lambda x: int(x.max() - x.min()), "bigint", aggregate=True)
    return engine.execute("SELECT o_orderstatus, width(o_custkey) AS v FROM orders GROUP BY o_orderstatus")


# --- decision support on integer dates and floating money -----------------------------------------

_DAY = "year({0}) * 10000 + month({0}) * 100 + day({0})"
_ITEMS = f"items AS (SELECT *, {_DAY.format('l_shipdate')} AS shipped, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status FROM lineitem)"
_BILLS = f"bills AS (SELECT *, {_DAY.format('o_orderdate')} AS ordered FROM orders)"
_NET = "l_extendedprice * (1 - l_discount)"
for _number, _text in {
    1: f"WITH {_ITEMS} SELECT flag, status, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_NET}), 2) AS sum_disc_price, round(sum({_NET} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM items WHERE shipped <= 20010902 GROUP BY flag, status ORDER BY flag, status",
    3: f"WITH {_ITEMS}, {_BILLS} SELECT l_orderkey, round(sum({_NET}), 2) AS revenue, ordered FROM customer JOIN bills ON c_custkey = o_custkey JOIN items ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND ordered < 19980315 AND shipped > 19980315 GROUP BY l_orderkey, ordered ORDER BY revenue DESC, l_orderkey LIMIT 10",
    4: f"WITH {_ITEMS}, {_BILLS} SELECT o_orderpriority, count(*) AS n FROM bills WHERE ordered >= 19970701 AND ordered < 19971001 AND EXISTS (SELECT 1 FROM items WHERE l_orderkey = o_orderkey AND flag = 2) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    6: f"WITH {_ITEMS} SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM items WHERE shipped >= 19970101 AND shipped < 19980101 AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24",
    10: f"WITH {_ITEMS}, {_BILLS} SELECT c_custkey, round(sum({_NET}), 2) AS revenue FROM customer JOIN bills ON c_custkey = o_custkey JOIN items ON l_orderkey = o_orderkey WHERE ordered >= 19971001 AND ordered < 19980101 AND flag = 2 GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20",
    12: f"WITH {_ITEMS} SELECT status, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM orders JOIN items ON o_orderkey = l_orderkey WHERE shipped >= 19980101 AND shipped < 19990101 GROUP BY status ORDER BY status",
    14: f"WITH {_ITEMS} SELECT round(100 * sum(CASE WHEN p_type = 'PROMO' THEN {_NET} ELSE 0 END) / sum({_NET}), 6) AS promo FROM items JOIN part ON l_partkey = p_partkey WHERE shipped >= 19970901 AND shipped < 19971001",
    17: "SELECT round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#1' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    18: f"WITH {_BILLS} SELECT o_orderkey, ordered, sum(l_quantity) AS q FROM bills JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY o_orderkey, ordered",
}.items():
    sql(f"tpch_mod_q{_number:02d}", _text)

# --- decision support with more kinds of grouping, ranking and channels ---------------------------

_CENTS = "CAST(round({0} * 100) AS BIGINT)"
_SALES = f"sales AS (SELECT o_custkey, o_orderkey, c_nationkey, c_mktsegment, o_orderstatus, o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m, {_CENTS.format('o_totalprice')} AS cents FROM orders JOIN customer ON o_custkey = c_custkey)"
for _name, _text in {
    "rollup_rank": f"WITH {_SALES}, g AS (SELECT c_mktsegment, o_orderstatus, CAST(grouping(c_mktsegment) + grouping(o_orderstatus) AS BIGINT) AS lochierarchy, CAST(sum(cents) AS BIGINT) AS cents FROM sales GROUP BY ROLLUP (c_mktsegment, o_orderstatus)) SELECT *, rank() OVER (PARTITION BY lochierarchy, CASE WHEN lochierarchy = 0 THEN c_mktsegment END ORDER BY cents DESC) AS place FROM g",
    "revenue_ratio": f"WITH {_SALES} SELECT c_mktsegment, o_orderpriority, CAST(sum(cents) AS BIGINT) AS cents, round(CAST(sum(cents) AS DOUBLE) * 100 / CAST(sum(sum(cents)) OVER (PARTITION BY c_mktsegment) AS DOUBLE), 6) AS ratio FROM sales GROUP BY c_mktsegment, o_orderpriority",
    "monthly_deviation": f"WITH {_SALES}, q AS (SELECT c_mktsegment, m, CAST(sum(cents) AS DOUBLE) AS s, avg(CAST(sum(cents) AS DOUBLE)) OVER (PARTITION BY c_mktsegment) AS a FROM sales GROUP BY c_mktsegment, m) SELECT c_mktsegment, m, s FROM q WHERE abs(s - a) / a > 0.05",
    "neighbour_months": f"WITH {_SALES}, q AS (SELECT c_mktsegment, y, m, CAST(sum(cents) AS BIGINT) AS s FROM sales GROUP BY c_mktsegment, y, m) SELECT c_mktsegment, y, m, s, lag(s) OVER w AS before, lead(s) OVER w AS after FROM q WINDOW w AS (PARTITION BY c_mktsegment ORDER BY y, m)",
    "intersect_channels": "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') t",
    "except_channels": "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') t",
    "union_rollup": f"SELECT channel, id, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM (SELECT 'orders' AS channel, CAST(o_custkey % 10 AS BIGINT) AS id, {_CENTS.format('o_totalprice')} AS cents FROM orders UNION ALL SELECT 'lines', CAST(l_suppkey % 10 AS BIGINT), {_CENTS.format('l_extendedprice')} FROM lineitem) t GROUP BY ROLLUP (channel, id)",
    "year_over_year": f"WITH {_SALES}, t AS (SELECT o_custkey, y, CAST(sum(cents) AS BIGINT) AS s FROM sales GROUP BY o_custkey, y) SELECT a.o_custkey, a.s AS one, b.s AS two FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND a.y = 1996 AND b.y = 1997 WHERE b.s > a.s * 2",
    "cumulative_full_join": "WITH a AS (SELECT o_custkey AS k, o_orderkey AS d, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS d, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.d, b.d) AS d, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.k = b.k AND a.d = b.d) SELECT k, d, max(an) OVER w AS an, max(bn) OVER w AS bn FROM c WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "case_of_scalars": "SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 100 THEN (SELECT max(l_discount) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT max(l_tax) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 1000000000 THEN 1.0 ELSE (SELECT min(l_tax) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS bucket2 FROM region WHERE r_regionkey = 1",
    "exists_or": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) GROUP BY c_mktsegment",
    "best_and_worst": "WITH r AS (SELECT l_partkey, avg(l_quantity) AS q FROM lineitem GROUP BY l_partkey), a AS (SELECT l_partkey, row_number() OVER (ORDER BY q, l_partkey) AS k FROM r), d AS (SELECT l_partkey, row_number() OVER (ORDER BY q DESC, l_partkey) AS k FROM r) SELECT a.k, a.l_partkey AS worst, d.l_partkey AS best FROM a JOIN d ON a.k = d.k WHERE a.k <= 10",
    "count_ratio": "SELECT CAST(a.n AS DOUBLE) / CAST(b.n AS DOUBLE) AS ratio FROM (SELECT count(*) AS n FROM events WHERE hour(ts) BETWEEN 8 AND 11) a CROSS JOIN (SELECT count(*) AS n FROM events WHERE hour(ts) BETWEEN 19 AND 22) b",
    "above_average_of_peers": f"WITH {_SALES}, t AS (SELECT o_custkey, c_nationkey, CAST(sum(cents) AS DOUBLE) AS s FROM sales GROUP BY o_custkey, c_nationkey) SELECT o_custkey, c_nationkey FROM t a WHERE s > (SELECT avg(s) * 1.2 FROM t b WHERE b.c_nationkey = a.c_nationkey)",
    "baskets": "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY o_custkey HAVING count(*) BETWEEN 4 AND 7) t JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'",
    "pivot_by_case": "SELECT c_mktsegment, count(CASE WHEN month(o_orderdate) <= 3 THEN 1 END) AS q1, count(CASE WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 1 END) AS q2, count(CASE WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 1 END) AS q3, count(CASE WHEN month(o_orderdate) >= 10 THEN 1 END) AS q4 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
}.items():
    sql(f"tpcds_{_name}", _text)
