"""A query for each operator, on the tables or on small inline rows where nulls matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import aggregate as A
from ..functions import scalar as X
from ..operators import aggregate, join, order, scan, window
from ..registry import frames, op, sql
from ..sources import files
from ..streaming import windows

# --- scans and sinks ------------------------------------------------------------------------------

sql("scan_single_col", "SELECT n_name FROM nation")
sql("scan_multi_col", "SELECT n_nationkey, n_name, n_regionkey FROM nation")


@op("scan_filter_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], (F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R"))


@op("scan_projection_pushdown", "SELECT l_partkey, l_discount FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_partkey", "l_discount"])


@op("scan_multi_file", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, [f"{sf_dir}/nation.parquet"] * 2).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@op("scan_cached", "SELECT count(*) AS n, min(s_name) AS lo FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scan.cached(scan.scan(spark, f"{sf_dir}/supplier.parquet", ["s_name"]), "table_host")
    return kept.agg(F.count("*").alias("n"), F.min("s_name").alias("lo"))


_NATION = "n_nationkey int, n_name string, n_regionkey int"
for _kind in files.DELIMITERS:

    @op(f"source_{_kind}", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    def _(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        path = files.scratch(spark, kind)
        files.write_delimited(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path, kind)
        return files.read_delimited(spark, path, _NATION, kind)


@op("sink_partitioned_parquet", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "orders")
    files.write_parquet(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return files.read_parquet(spark, path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@op("engine_parameters", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_type = 'PROMO'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir, ["part"]).execute("SELECT p_partkey FROM part WHERE p_size > :size AND p_type = :kind", {"size": 40, "kind": "PROMO"})


@op("engine_composed", "SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey > 3) t GROUP BY n_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir, ["nation"])
    inner = engine.execute("SELECT n_regionkey, n_name FROM nation WHERE n_nationkey > 3")
    return engine.execute("SELECT n_regionkey, count(*) AS n FROM {inner} GROUP BY n_regionkey", inner=inner)




@op("values_scan", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.values(spark, [(1, "x"), (2, None), (None, "z")], "a long, b string")


@frames("empty_result", "SELECT n_name FROM nation WHERE 1 = 0")
def _(nation: DataFrame) -> DataFrame:
    return scan.empty(nation.select("n_name"))


@op("dummy_scan", "SELECT CAST(42 AS BIGINT) AS answer, 'x' AS s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.one_row(spark).select(F.lit(42).cast("bigint").alias("answer"), F.lit("x").alias("s"))



# --- projections and filters ----------------------------------------------------------------------

_ARITHMETIC = {
    "add": "l_orderkey + l_linenumber",
    "sub": "l_orderkey - l_partkey",
    "mul": "l_orderkey * l_linenumber",
    "div": "l_quantity / l_linenumber",
    "mod": "l_orderkey % l_linenumber",
}
for _name, _x in _ARITHMETIC.items():
    sql(f"proj_{_name}", f"SELECT l_orderkey, l_linenumber, {_x} AS v FROM lineitem")


@frames("proj_intdiv", "SELECT l_orderkey, TRY(CAST((l_orderkey - 500) // (l_linenumber - 2) AS BIGINT)) AS v, TRY((l_orderkey - 500) % (l_linenumber - 2)) AS m FROM lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    a, b = F.col("l_orderkey") - 500, F.col("l_linenumber") - 2
    return lineitem.select("l_orderkey", X.integer_division(a, b).alias("v"), X.modulo(a, b).alias("m"))


sql("proj_reorder_dup", "SELECT n_name AS b, n_nationkey AS a, n_name AS c FROM nation")
sql("proj_decimal", "SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS v FROM lineitem")
for _name, _x in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    sql(f"filter_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_x} 25")
    sql(f"filter_string_{_name}", f"SELECT p_partkey, p_brand FROM part WHERE p_brand {_x} 'Brand#2'")
sql("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-02-01 00:00:00'")
sql("filter_date", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-01-05'")
sql("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_type = 'PROMO') AND NOT p_brand = 'Brand#3'")
sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
sql("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR p_type IN ('PROMO', 'SMALL')")
sql("filter_not_in", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9)")
_T = "(VALUES (3, 1), (NULL, 2), (3, 3), (NULL, 4), (2, 5)) AS t(a, b)"
sql("filter_is_null", f"SELECT b FROM {_T} WHERE a IS NULL")
sql("filter_is_not_null", f"SELECT b FROM {_T} WHERE a IS NOT NULL")
sql("filter_null_comparison", f"SELECT b FROM {_T} WHERE a = NULL OR a = 3")
sql("filter_kleene", f"SELECT b, (a = 3 OR b > 3) AS either, (a = 3 AND b > 3) AS both FROM {_T}")
sql("filter_distinct_from", f"SELECT b, a IS DISTINCT FROM 3 AS d, a IS NOT DISTINCT FROM NULL AS n FROM {_T}")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR p_name LIKE 's_all%'")
sql("filter_not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%widget'")
sql("filter_coalesce", f"SELECT b, COALESCE(a, -1) AS a FROM {_T} WHERE COALESCE(a, 0) < 3")

# --- joins ----------------------------------------------------------------------------------------

_L = "(VALUES (1, 'a', 10), (2, 'b', 20), (2, 'c', 25), (NULL, 'd', 30), (5, 'e', 50)) AS l(k, x, p)"
_R = "(VALUES (1, 'p', 5), (2, 'q', 22), (NULL, 'r', 1), (7, 's', 70), (2, 't', 40)) AS r(k, y, q)"


def _sides(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.sql(f"SELECT * FROM {_L}"), spark.sql(f"SELECT k AS rk, y, q FROM {_R}")


_SQL_KINDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}


def _register(kind: str) -> None:
    right_side = kind.startswith("right_")
    base = kind.removeprefix("right_")
    some = base in ("semi", "anti")
    both = "x, y" if not some else ("y" if right_side else "x")
    out = ["x", "y"] if not some else (["y"] if right_side else ["x"])
    exists = "EXISTS" if base == "semi" else "NOT EXISTS"

    def text(on: str) -> str:
        if some:
            a, b = (_R, _L) if right_side else (_L, _R)
            return f"SELECT {both} FROM {a} WHERE {exists} (SELECT 1 FROM {b} WHERE {on})"
        return f"SELECT {both} FROM {_L} {_SQL_KINDS[kind]} {_R} ON {on}"

    def add(name: str, on_sql: str, on):
        @op(f"join_{name}_{kind}" if name != "equi" else f"join_{kind}_equi", text(on_sql))
        def _(spark: SparkSession, sf_dir: str) -> DataFrame:
            a, b = _sides(spark)
            return join.join(a, b, on(a, b), kind).select(*out)

    add("equi", "l.k = r.k", lambda a, b: a.k == b.rk)
    add("mixed", "l.k = r.k AND p > q", lambda a, b: (a.k == b.rk) & (a.p > b.q))
    add("theta", "p < q", lambda a, b: a.p < b.q)


for _kind in (*_SQL_KINDS, "right_semi", "right_anti"):
    _register(_kind)

_CUSTOMER_ORDERS = "customer {} orders ON c_custkey = o_custkey AND o_totalprice > 400000"
for _kind, _word in _SQL_KINDS.items():
    if _kind not in ("semi", "anti"):
        sql(f"join_large_{_kind}", f"SELECT c_custkey, o_orderkey FROM {_CUSTOMER_ORDERS.format(_word)}")
sql("join_large_semi", f"SELECT c_custkey FROM {_CUSTOMER_ORDERS.format('LEFT SEMI JOIN')}", f"SELECT c_custkey FROM {_CUSTOMER_ORDERS.format('SEMI JOIN')}")
sql("join_large_anti", f"SELECT c_custkey FROM {_CUSTOMER_ORDERS.format('LEFT ANTI JOIN')}", f"SELECT c_custkey FROM {_CUSTOMER_ORDERS.format('ANTI JOIN')}")


def _register_on_tables(kind: str) -> None:
    """The same kinds over whole tables: no predicate leaves rows out before the join."""
    base = kind.removeprefix("right_")
    some = base in ("semi", "anti")

    def add(name: str, other: str, key: str, on: str):
        out = ["c_custkey", key] if not some else [key if kind.startswith("right_") else "c_custkey"]
        if some:
            a, b = (other, "customer") if kind.startswith("right_") else ("customer", other)
            text = f"SELECT {out[0]} FROM {a} WHERE {'NOT ' * (base == 'anti')}EXISTS (SELECT 1 FROM {b} WHERE {on})"
        else:
            text = f"SELECT c_custkey, {key} FROM customer {_SQL_KINDS[kind]} {other} ON {on}"

        @op(f"join_tables_{name}_{kind}", text)
        def _(spark: SparkSession, sf_dir: str) -> DataFrame:
            a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", other))
            return join.join(a, b, F.expr(on), kind).select(*out)

    add("equi", "orders", "o_orderkey", "c_custkey = o_custkey")
    add("mixed", "orders", "o_orderkey", "c_custkey = o_custkey AND c_acctbal * 50 > o_totalprice")
    add("theta", "nation", "n_nationkey", "c_acctbal > n_nationkey * 450")


for _kind in (*_SQL_KINDS, "right_semi", "right_anti"):
    _register_on_tables(_kind)


@frames("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
def _(lineitem: DataFrame) -> DataFrame:
    """A key of m rows has m * m pairs, which are counted without being made."""
    a = aggregate.counted(lineitem, ["l_orderkey", "l_linenumber"], "__a")
    b = a.select(F.col("l_orderkey").alias("__o"), F.col("l_linenumber").alias("__l"), F.col("__a").alias("__b"))
    return join.equi(a, b, [("l_orderkey", "__o"), ("l_linenumber", "__l")]).select("l_orderkey", "l_linenumber", (F.col("__a") * F.col("__b")).alias("n"))


sql("join_cast_key", "SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey = c_custkey")
sql("join_expression_key", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey + 1 = c_custkey")
for _name, _on in {"ne": "n_regionkey <> r_regionkey", "lt": "n_regionkey < r_regionkey", "le": "n_regionkey <= r_regionkey", "ge": "n_regionkey >= r_regionkey", "two": "n_regionkey < r_regionkey AND n_nationkey > r_regionkey + 3", "expr": "n_regionkey * 2 > r_regionkey + 1"}.items():
    sql(f"join_nlj_{_name}", f"SELECT n_name, r_name FROM nation JOIN region ON {_on}")
sql("join_nlj_distinct", f"SELECT x, y FROM {_L} JOIN {_R} ON l.k IS DISTINCT FROM r.k")
sql("join_null_keys", f"SELECT x, y FROM {_L} FULL JOIN {_R} ON l.k = r.k AND r.k IS NOT NULL")


@op("join_null_safe", f"SELECT x, y FROM {_L} JOIN {_R} ON l.k IS NOT DISTINCT FROM r.k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark)
    return join.equi(a, b, [("k", "rk")], nulls_match=True).select("x", "y")


@frames("join_mark_in_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return join.mark(customer, orders.where("o_totalprice > 450000"), [("c_custkey", "o_custkey")]).where((F.col("c_acctbal") < 0) | F.col("mark")).select("c_custkey")


@frames("join_broadcast", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(join.small(nation), customer.c_nationkey == nation.n_nationkey).select("c_name", "n_name")


@frames("join_salted", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    both = join.salted(orders.withColumnRenamed("o_custkey", "k"), customer.select(F.col("c_custkey").alias("k")), "k", 8)
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@frames("join_as_of", "SELECT l_orderkey, l_linenumber, l_partkey, o.event_id FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS u, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(l_orderkey % 40000 AS INT)) AS t FROM lineitem) l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) o ON l.u = o.user_id AND l.t >= o.ts")
def _(lineitem: DataFrame, events: DataFrame) -> DataFrame:
    left = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("user_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(l_orderkey % 40000 AS INT))").alias("ts"))
    right = events.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return join.as_of(left, right, "user_id", "ts", "event_id").select("l_orderkey", "l_linenumber", "l_partkey", "event_id")


sql("cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region")

# --- subqueries and CTEs --------------------------------------------------------------------------

sql("exists_corr", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("not_exists_corr", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("exists_under_or", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
sql("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount = 0.1)")
sql("not_in_subquery_null", f"SELECT x FROM {_L} WHERE k NOT IN (SELECT k FROM {_R})")
sql("scalar_uncorr", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) - 500 FROM supplier)")
sql("scalar_corr_avg", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
sql("delim_join_null_safe", f"SELECT x, (SELECT max(q) FROM {_R} WHERE r.k IS NOT DISTINCT FROM l.k) AS m FROM {_L}", f"SELECT x, (SELECT max(q) FROM {_R} WHERE r.k IS NOT DISTINCT FROM l.k) AS m FROM {_L}")
sql("cte_materialized_twice", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM big a JOIN (SELECT max(n) AS m FROM big) b ON a.n = b.m")
sql("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n, CAST(f AS BIGINT) AS f FROM r")


@op("not_in_operator", f"SELECT x FROM {_L} WHERE k NOT IN (SELECT k FROM {_R} WHERE k IS NOT NULL)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark)
    return join.not_in(a, b.where("rk IS NOT NULL"), "k", "rk").select("x")


# --- aggregates -----------------------------------------------------------------------------------

_MONEY = "CAST({} AS DECIMAL(12,2))"


@frames("agg_ungrouped_all", f"SELECT CAST(sum({_MONEY.format('l_extendedprice')}) AS DOUBLE) AS s, count(*) AS n, count(l_tax) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum({_MONEY.format('l_quantity')}) AS DOUBLE) / count(*) AS a FROM lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return aggregate.group(lineitem, [], A.sum_exact(F.col("l_extendedprice")).alias("s"), F.count("*").alias("n"), F.count("l_tax").alias("c"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), A.avg_exact(F.col("l_quantity")).alias("a"))


sql("agg_group_one_key", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_orderstatus")
sql("agg_group_two_keys", f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_MONEY.format('l_extendedprice')}) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_expression", "SELECT l_linenumber % 2 AS odd, count(*) AS n FROM lineitem GROUP BY l_linenumber % 2")


@frames("agg_keys_only", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return aggregate.distinct_keys(lineitem, "l_partkey", "l_suppkey")


sql("agg_null_group", f"SELECT a, count(*) AS n, count(a) AS c, CAST(sum(b) AS BIGINT) AS s FROM {_T} GROUP BY a")
sql("agg_string_minmax", "SELECT p_type, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_type")
sql("agg_avg_int", "SELECT p_brand, avg(p_size) AS a FROM part GROUP BY p_brand")


@frames("agg_avg_decimal", f"SELECT p_type, CAST(sum({_MONEY.format('p_retailprice')}) AS DOUBLE) / count(p_retailprice) AS a FROM part GROUP BY p_type")
def _(part: DataFrame) -> DataFrame:
    return part.groupBy("p_type").agg(A.avg_decimal(F.col("p_retailprice").cast("decimal(12,2)")).alias("a"))


sql("agg_sum_decimal", f"SELECT p_brand, CAST(sum({_MONEY.format('p_retailprice')}) AS DOUBLE) AS s FROM part GROUP BY p_brand")
sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_count_distinct_ungrouped", "SELECT count(DISTINCT l_suppkey) AS n, count(DISTINCT l_returnflag) AS f FROM lineitem")
_PAIRS = "(VALUES (1, 'a'), (1, NULL), (1, NULL), (NULL, NULL), (2, 'a'), (2, 'a')) AS t(a, b)"


@op("agg_count_distinct_tuple", f"SELECT count(DISTINCT (a, b)) AS n FROM {_PAIRS}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_PAIRS}").agg(A.count_distinct(F.col("a"), F.col("b")).alias("n"))


@frames("agg_count_distinct_skewed", "SELECT l_linestatus, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_linestatus")
def _(lineitem: DataFrame) -> DataFrame:
    return aggregate.count_distinct_by(lineitem, ["l_linestatus"], ["l_orderkey"], "n")


sql("agg_mixed_distinct", "SELECT l_linestatus, count(DISTINCT l_partkey) AS d, count(*) AS n, max(l_quantity) AS hi FROM lineitem GROUP BY l_linestatus")
sql("agg_sum_distinct", f"SELECT CAST(sum(DISTINCT b % 3) AS BIGINT) AS s FROM {_T}")
sql("agg_first", "SELECT first(r_name) AS f FROM (SELECT r_name FROM region WHERE r_regionkey = 2)")
sql("agg_empty_input", f"SELECT count(*) AS n, CAST(sum(b) AS BIGINT) AS s, min(b) AS lo, avg(b) AS a FROM {_T} WHERE b > 100")
sql("agg_empty_groups", f"SELECT a, count(*) AS n FROM {_T} WHERE b > 100 GROUP BY a")
sql("agg_all_null", "SELECT count(a) AS c, CAST(sum(a) AS BIGINT) AS s FROM (SELECT CAST(NULL AS BIGINT) AS a UNION ALL SELECT CAST(NULL AS BIGINT)) t")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 300000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql("agg_case_sum", "SELECT p_type, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM part GROUP BY p_type")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("agg_statistics", "SELECT p_type, round(stddev_samp(p_size), 6) AS sd, round(var_pop(p_size), 6) AS vp, CAST(median(p_size) AS DOUBLE) AS med FROM part GROUP BY p_type")

# --- order, top-n, limits -------------------------------------------------------------------------


@frames("order_asc", "SELECT n_name FROM nation ORDER BY n_name")
def _(nation: DataFrame) -> DataFrame:
    return order.order_by(nation.select("n_name"), "n_name")


@frames("order_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def _(orders: DataFrame) -> DataFrame:
    return order.order_by(orders.select("o_orderkey", "o_totalprice"), "-o_totalprice")


@frames("order_multi_key", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def _(part: DataFrame) -> DataFrame:
    return order.order_by(part.select("p_brand", "p_size", "p_partkey"), "p_brand", "-p_size", "p_partkey")


sql("order_key_not_selected", "SELECT s_name FROM supplier ORDER BY s_acctbal")
sql("order_nulls", f"SELECT a, b FROM {_T} ORDER BY a ASC NULLS FIRST, b LIMIT 3")


@op("order_nulls_last", f"SELECT a, b FROM {_T} ORDER BY a DESC NULLS LAST, b LIMIT 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.top_n(spark.sql(f"SELECT a, b FROM {_T}"), 3, "-a", "b")


@frames("topn_single", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(orders: DataFrame) -> DataFrame:
    return order.top_n(orders.select("o_orderkey", "o_totalprice"), 10, "-o_totalprice", "o_orderkey")


_ALL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@frames("topn_multi", f"SELECT * FROM lineitem ORDER BY {', '.join(_ALL)} LIMIT 50")
def _(lineitem: DataFrame) -> DataFrame:
    return order.top_n(lineitem, 50, *_ALL)


@frames("topn_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
def _(customer: DataFrame) -> DataFrame:
    return order.top_n(customer.select("c_custkey", "c_acctbal"), 10, "-c_acctbal", "c_custkey", offset=20)


@frames("limit_zero", "SELECT n_name FROM nation LIMIT 0")
def _(nation: DataFrame) -> DataFrame:
    return order.limit(nation.select("n_name"), 0)


@frames("limit_all", "SELECT n_name FROM nation LIMIT 1000")
def _(nation: DataFrame) -> DataFrame:
    return order.limit(nation.select("n_name"), 1000)


@frames("limit_count", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 100) t")
def _(lineitem: DataFrame) -> DataFrame:
    return order.limit(lineitem.select("l_orderkey"), 100).agg(F.count("*").alias("n"))


@frames("limit_offset_past_end", "SELECT n_name FROM nation LIMIT 10 OFFSET 1000")
def _(nation: DataFrame) -> DataFrame:
    return order.limit(nation.select("n_name"), 10, 1000)


# --- scalar functions -----------------------------------------------------------------------------


def _function(name: str, table: str, oracle: str, columns) -> None:
    @op(name, oracle)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[c.alias(n) for n, c in columns().items()])


_function("fn_substring", "part", "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_name, 0, 3) AS z, substring(p_name, -3, 2) AS e FROM part", lambda: dict(p_partkey=F.col("p_partkey"), a=X.substring(F.col("p_name"), 2, 4), z=X.substring(F.col("p_name"), 0, 3), e=X.substring(F.col("p_name"), -3, 2)))
_function("fn_like", "part", "SELECT p_partkey, p_name LIKE '%e_ w%' AS l FROM part", lambda: dict(p_partkey=F.col("p_partkey"), l=X.like(F.col("p_name"), "%e_ w%")))
_function("fn_contains", "pages", "SELECT page_id, contains(url, 'example') AS v FROM pages", lambda: dict(page_id=F.col("page_id"), v=X.contains(F.col("url"), "example")))
_function("fn_prefix", "pages", "SELECT page_id, prefix(url, 'https') AS v FROM pages", lambda: dict(page_id=F.col("page_id"), v=X.prefix(F.col("url"), "https")))
_function("fn_suffix", "pages", "SELECT page_id, suffix(url, '1') AS v FROM pages", lambda: dict(page_id=F.col("page_id"), v=X.suffix(F.col("url"), "1")))
_function("fn_strlen", "documents", "SELECT doc_id, strlen(text) AS v FROM documents", lambda: dict(doc_id=F.col("doc_id"), v=X.strlen(F.col("text"))))
_function("fn_length", "documents", "SELECT doc_id, length(text) AS v FROM documents", lambda: dict(doc_id=F.col("doc_id"), v=X.length(F.col("text"))))
_function("fn_regexp_replace", "pages", r"SELECT page_id, regexp_replace(url, '[aeiou]+', '<>') AS one, regexp_replace(url, '[aeiou]+', '<>', 'g') AS every FROM pages", lambda: dict(page_id=F.col("page_id"), one=X.regexp_replace(F.col("url"), "[aeiou]+", "<>"), every=X.regexp_replace(F.col("url"), "[aeiou]+", "<>", True)))
_function("fn_regexp_backref", "pages", r"SELECT page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS v FROM pages", lambda: dict(page_id=F.col("page_id"), v=X.regexp_replace(F.col("url"), r"^https?://(?:www\.)?([^/]+)/.*$", r"\1", True)))
_function("fn_regexp_backref_first", "pages", r"SELECT page_id, regexp_replace(url, '([a-z])([a-z])', '\2\1') AS v FROM pages", lambda: dict(page_id=F.col("page_id"), v=X.regexp_replace(F.col("url"), "([a-z])([a-z])", r"\2\1")))
for _unit in ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond"):
    _function(f"fn_{_unit}", "events", f"SELECT event_id, CAST({_unit}(ts) AS BIGINT) AS v FROM events", lambda u=_unit: dict(event_id=F.col("event_id"), v=getattr(X, u)(F.col("ts"))))
for _unit in ("day", "hour", "minute", "second", "millisecond", "microsecond"):
    _function(f"fn_date_trunc_{_unit}", "events", f"SELECT event_id, CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS v FROM events", lambda u=_unit: dict(event_id=F.col("event_id"), v=X.date_trunc(u, F.col("ts"))))
sql("fn_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS v, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS promo FROM part")
sql("fn_cast", "SELECT l_orderkey, CAST(l_orderkey AS INT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_discount AS DECIMAL(4,2)) = 0.05 AS five, CAST(l_shipdate AS DATE) AS day FROM lineitem")


@op("fn_cast_round", "SELECT x, CAST(x AS BIGINT) AS i, CAST(CAST(x AS DECIMAL(5,1)) AS BIGINT) AS d FROM (VALUES (2.5::DOUBLE), (3.5), (-2.5), (2.4), (NULL)) AS t(x)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT CAST(x AS DOUBLE) AS x FROM (VALUES (2.5), (3.5), (-2.5), (2.4), (NULL)) AS t(x)")
    return rows.select("x", X.to_integer(F.col("x")).alias("i"), X.to_integer(F.col("x").cast("decimal(5,1)"), exact=True).alias("d"))


sql("fn_struct", "SELECT s.a AS a, s.b AS b FROM (SELECT named_struct('a', n_nationkey, 'b', n_name) AS s FROM nation) t", "SELECT s.a AS a, s.b AS b FROM (SELECT struct_pack(a := n_nationkey, b := n_name) AS s FROM nation) t")
sql("fn_in_list_strings", "SELECT event_id, event_type IN ('click', 'view') AS v, event_type NOT IN ('error') AS w FROM events")
sql("fn_error", "SELECT CASE WHEN count(*) > 100 THEN CAST(raise_error('too many') AS INT) ELSE 1 END AS v FROM region", "SELECT CASE WHEN count(*) > 100 THEN CAST(error('too many') AS INT) ELSE 1 END AS v FROM region")
sql("fn_error_guard", "SELECT CASE WHEN count(*) > 1 THEN 'many' ELSE 'one' END AS v FROM region")

# --- set operations, windows and more -------------------------------------------------------------

sql("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
sql("distinct_rows", "SELECT DISTINCT event_type, user_id % 5 AS g FROM events")

@frames("window_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
def _(orders: DataFrame) -> DataFrame:
    rows = orders.count()
    cut = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ranked = window.ranks(cut, ["o_orderstatus"], ["o_orderpriority"], ["o_totalprice", "o_orderkey"], "r", "d", rows=rows).drop("number", "o_orderpriority")
    return window.ranks(ranked, ["o_orderstatus"], ["-o_totalprice", "o_orderkey"], number="n", rows=rows).select("o_orderkey", "r", "d", "n")


@frames("window_running_sum", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def _(orders: DataFrame) -> DataFrame:
    return window.running_sum(orders.select("o_orderpriority", "o_orderkey", "o_custkey"), ["o_orderpriority"], ["o_orderkey"], "o_custkey", "s").select("o_orderkey", "s")


sql("window_lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events")
sql("window_frame", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM events")


@frames("window_ntile", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part")
def _(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).cast("bigint").alias("q"))


sql("unnest_array", "SELECT n_nationkey, explode(array(n_regionkey, n_nationkey)) AS v FROM nation", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS v FROM nation")


@frames("pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@frames("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(events: DataFrame) -> DataFrame:
    return windows.tumbling(events, "ts", "1 hour", ["event_type"], F.count("*").alias("n"))


@frames("stream_sliding", "SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - unnest([INTERVAL '0 hour', INTERVAL '1 hour']) AS s FROM events) t GROUP BY s")
def _(events: DataFrame) -> DataFrame:
    return windows.sliding(events, "ts", "2 hours", "1 hour", [], F.count("*").alias("n"))


@frames(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) "
    "SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n FROM n GROUP BY user_id, s",
)
def _(events: DataFrame) -> DataFrame:
    return windows.sessions(events, "ts", "6 hours", ["user_id"], F.count("*").alias("n"))
