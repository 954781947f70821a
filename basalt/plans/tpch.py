"""The 22 decision-support queries, on the tables that are there.

Money is summed exactly, so results don't hang on the order of addition.  What the tables lack is
replaced as follows: `partsupp` comes from lineitem, with the smallest price as its cost; the dates of commit and receipt by the return flag;
ship modes by the line status; phone prefixes by the customer's nation.
"""

from __future__ import annotations

from ..registry import sql

def decimal_total(x: str, places: int) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


def long_total(x: str, places: int) -> str:
    """The sum of whole units of 10**-places: two sums of longs, which no number of rows overflows, put together once a group."""
    return f"CAST((CAST(sum(({x}) div 1048576) AS DECIMAL(27,0)) * 1048576 + sum(({x}) % 1048576)) * {'0.' + '0' * (places - 1) + '1' if places else '1'} AS DOUBLE)"


#: What the host database computes: exact decimals.
DECIMALS = {
    "EP": "CAST(l_extendedprice AS DECIMAL(12,2))",
    "DISC": "CAST(l_discount AS DECIMAL(4,2))",
    "QTY": "CAST(l_quantity AS DECIMAL(12,2))",
    "REV": "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))",
    "TAXED": "* (1 + CAST(l_tax AS DECIMAL(4,2)))",
    "COST": "ps_supplycost * CAST(l_quantity AS DECIMAL(4,0))",
    "BAL": "CAST(c_acctbal AS DECIMAL(12,2))",
    "total": decimal_total,
}
#: The same on Spark, where sums of decimals over 18 digits make an object a row: cents and hundredths as longs (by rint, as round makes an object too).
LONGS = {
    "EP": "CAST(rint(l_extendedprice * 100) AS BIGINT)",
    "DISC": "CAST(rint(l_discount * 100) AS BIGINT)",
    "QTY": "CAST(l_quantity AS BIGINT)",
    "REV": "CAST(rint(l_extendedprice * 100) AS BIGINT) * (100 - CAST(rint(l_discount * 100) AS BIGINT))",
    "TAXED": "* (100 + CAST(rint(l_tax * 100) AS BIGINT))",
    "COST": "ps_supplycost * 100 * CAST(l_quantity AS BIGINT)",
    "BAL": "CAST(rint(c_acctbal * 100) AS BIGINT)",
    "total": long_total,
}


def texts(EP: str, DISC: str, QTY: str, REV: str, TAXED: str, COST: str, BAL: str, total) -> dict[int, str]:  # noqa: N803
    partsupp = f"""partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min({EP}) AS ps_supplycost, sum({QTY}) AS ps_availqty
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
    return {
        1: f"""
SELECT l_returnflag, l_linestatus, {total(QTY, 0)} AS sum_qty, {total(EP, 2)} AS sum_base_price, {total(REV, 4)} AS sum_disc_price,
       {total(f"{REV} {TAXED}", 6)} AS sum_charge, {total(QTY, 0)} / count(*) AS avg_qty, {total(EP, 2)} / count(*) AS avg_price,
       {total(DISC, 2)} / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        2: f"""
WITH {partsupp},
offers AS (
  SELECT ps_partkey, ps_supplycost, s_name, s_acctbal, n_name FROM partsupp
  JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN offers o ON p_partkey = ps_partkey
WHERE p_size < 25 AND p_type = 'ECONOMY' AND ps_supplycost = (SELECT min(i.ps_supplycost) FROM offers i WHERE i.ps_partkey = part.p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
        3: f"""
SELECT l_orderkey, {total(REV, 4)} AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        4: """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
        5: f"""
SELECT n_name, {total(REV, 4)} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC""",
        6: f"""
SELECT {total(f"{EP} * {DISC}", 4)} AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
        7: f"""
SELECT supp_nation, cust_nation, l_year, {total("volume", 4)} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {REV} AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
        8: f"""
SELECT o_year, {total("CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END", 4)} / {total("volume", 4)} AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REV} AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
  JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
        9: f"""
WITH {partsupp}
SELECT nation, o_year, {total("amount", 4)} AS sum_profit FROM (
  SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REV} - {COST} AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_name LIKE '%widget%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
        10: f"""
SELECT c_custkey, c_name, {total(REV, 4)} AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        11: f"""
WITH {partsupp},
held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_7', 'NATION_8'))
SELECT ps_partkey, {total("value", 2)} AS value FROM held GROUP BY ps_partkey
HAVING {total("value", 2)} > (SELECT {total("value", 2)} * 0.001 FROM held) ORDER BY value DESC, ps_partkey""",
        12: """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'
GROUP BY l_linestatus ORDER BY l_linestatus""",
        13: """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
        14: f"""
SELECT 100.0 * {total(f"CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END", 4)} / {total(REV, 4)} AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""",
        15: f"""
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, {total(REV, 4)} AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
        16: f"""
WITH {partsupp}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
        17: f"""
SELECT {total(EP, 2)} / 7.0 AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#1' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
        18: f"""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {total(QTY, 0)} AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum({QTY}) > 250)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
        19: f"""
SELECT {total(REV, 4)} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 25 AND l_quantity >= 1 AND l_quantity <= 21 AND l_returnflag IN ('A', 'R'))
   OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity >= 10 AND l_quantity <= 30 AND l_returnflag IN ('A', 'R'))
   OR (p_brand = 'Brand#4' AND p_size BETWEEN 1 AND 35 AND l_quantity >= 20 AND l_quantity <= 40 AND l_returnflag IN ('A', 'R'))""",
        20: f"""
WITH {partsupp}
SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey = 3 AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'))
ORDER BY s_name""",
        21: """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_regionkey = 1
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
        22: f"""
SELECT cntrycode, count(*) AS numcust, {total("bal", 2)} AS totacctbal FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS cntrycode, {BAL} AS bal FROM customer
  WHERE c_nationkey IN (13, 1, 3, 9, 10, 18, 17)
    AND c_acctbal > (SELECT {total(BAL, 2)} / count(*) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (13, 1, 3, 9, 10, 18, 17))
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) custsale
GROUP BY cntrycode ORDER BY cntrycode""",
    }


def spark_texts() -> dict[int, str]:
    """The texts on longs; where one has the same sums of lineitem twice they are made once here."""
    m = LONGS
    return texts(**m) | {
        2: f"""
WITH partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min({m['EP']}) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey),
offers AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY ps_partkey) AS least
  FROM partsupp JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'EUROPE' AND p_size < 25 AND p_type = 'ECONOMY')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers WHERE ps_supplycost = least
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
        11: f"""
WITH held AS (
  SELECT ps_partkey, CAST(sum(ps_supplycost * ps_availqty) AS DECIMAL(38,0)) AS cents FROM (
    SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min({m['EP']}) AS ps_supplycost, sum({m['QTY']}) AS ps_availqty FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_7', 'NATION_8'))
    GROUP BY l_partkey, l_suppkey) p
  GROUP BY ps_partkey)
SELECT ps_partkey, CAST(cents * 0.01 AS DOUBLE) AS value FROM held
WHERE CAST(cents * 0.01 AS DOUBLE) > (SELECT CAST(sum(cents) * 0.01 AS DOUBLE) * 0.001 FROM held) ORDER BY value DESC, ps_partkey""",
        20: f"""
WITH shipped AS (
  SELECT l_suppkey, sum({m['QTY']}) AS available,
         0.5 * sum(l_quantity) FILTER (WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00') AS half
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY l_partkey, l_suppkey)
SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey = 3 AND s_suppkey IN (SELECT l_suppkey FROM shipped WHERE available > half) ORDER BY s_name""",
    }


ORACLES = texts(**DECIMALS)
QUERIES = spark_texts()
for number, text in QUERIES.items():
    sql(f"tpch_q{number:02d}", text, ORACLES[number])
