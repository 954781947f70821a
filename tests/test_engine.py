"""Sessions, functions, operators, files and streams."""

from __future__ import annotations

import datetime
import os
import re
import subprocess

import duckdb
import pyspark
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt import Engine, session
from basalt.functions import aggregate as A
from basalt.functions import scalar as X
from basalt.operators import aggregate, join, order, scan, window
from basalt.sources import files
from basalt.streaming import windows


@pytest.mark.parametrize(("text", "size"), [("2 GB", 2 * 10**9), ("2 GiB", 2 << 30), ("512mb", 512 * 10**6), ("7", 7), (9, 9), ("1.5 KiB", 1536)])
def test_sizes(text, size):
    assert session.parse_size(text) == size


def test_bad_options():
    with pytest.raises(ValueError):
        session.parse_size("much")
    with pytest.raises(KeyError):
        session.settings(no_such="1")
    assert session.settings(hash_partition_bytes="512 MiB")["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(512 << 20)


def host(expression: str, *values):
    return duckdb.execute(f"SELECT {expression}", list(values)).fetchall()[0][0]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab\\%_é\n", max_size=6), st.text("ab\\%_\n", max_size=4))
def test_like_has_no_escape(spark, text, pattern):
    found = spark.createDataFrame([(text,)], "s string").select(X.like(F.col("s"), pattern)).collect()[0][0]
    assert found == host("? LIKE ?", text, pattern)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("héllo", max_size=6), st.integers(-9, 9), st.integers(-9, 9))
def test_substring(spark, text, start, size):
    found = spark.createDataFrame([(text,)], "s string").select(X.substring(F.col("s"), start, size)).collect()[0][0]
    assert found == host(f"substring(?, {start}, {size})", text)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab1\n$\\", max_size=8), st.sampled_from(["a", "a|b", "a|(b)", "(a)(b)?", "a.b", "[ab]+", "b$", "^a", "[$a]", r"\\", "a*", "(a|b)1"]), st.sampled_from(["X", r"<\0>", r"\1", r"\11", "$1", r"x\\y", "1"]), st.booleans())
def test_regexp_replace(spark, text, pattern, new, everywhere):
    groups = pattern.count("(")
    if any(int(d) > groups for d in re.findall(r"(?<!\\)\\(\d)", new)):
        return  # no such group
    found = spark.createDataFrame([(text,)], "s string").select(X.regexp_replace(F.col("s"), pattern, new, everywhere)).collect()[0][0]
    assert found == host("regexp_replace(?, ?, ?" + ", 'g'" * everywhere + ")", text, pattern, new)


def test_times(spark):
    moment = datetime.datetime(2024, 2, 29, 23, 59, 3, 456789)
    t = F.lit(moment).cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    row = spark.range(1).select(X.millisecond(t).alias("ms"), X.microsecond(t).alias("us"), X.second(t).alias("s"), X.date_trunc("minute", t).alias("m")).collect()[0]
    assert row.asDict() == {"ms": 3456, "us": 3456789, "s": 3, "m": datetime.datetime(2024, 2, 29, 23, 59)}


def test_division_by_zero_is_null(spark):
    row = spark.createDataFrame([(7, 0), (-7, 2)], "a long, b long").select(X.integer_division(F.col("a"), F.col("b")), X.modulo(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in row] == [(None, None), (-3, -1)]


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "x double, d decimal(5,2)")
    assert df.agg(A.sum_exact(F.col("x"))).collect()[0][0] is None
    assert aggregate.group(df, [], F.count("*").alias("n")).collect()[0].n == 0
    assert aggregate.group(df, ["x"], F.count("*").alias("n")).count() == 0


def test_count_distinct_by_matches_plain(spark):
    rows = [(1, 2), (1, 2), (1, None), (None, 3), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "g int, v int")
    plain = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    found = aggregate.count_distinct_by(df, ["g"], ["v"], "n")
    assert {r.g: r.n for r in found.collect()} == plain
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {r.g: r.n for r in aggregate.count_distinct_by(df, ["g"], ["g", "v"], "n").collect()} == {1: 2, None: 2, 2: 1}


def sides(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r"), (9, "s")], "rk int, y string")
    return a, b


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti", "right_semi", "right_anti"])
def test_joins_with_an_empty_side(spark, how):
    a, b = sides(spark)
    for left, right in ((a.where("false"), b), (a, b.where("false"))):
        n = join.join(left, right, left.k == right.rk, how).count()
        keeps_left = how in ("left", "full", "anti")
        keeps_right = how in ("right", "full", "right_anti")
        assert n == keeps_left * left.count() + keeps_right * right.count()


def test_salted_join_matches_plain(spark):
    a = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 1)], "k int, v int")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, w string")
    for how in ("inner", "left", "semi", "anti"):
        plain = a.join(b.withColumnRenamed("k", "rk"), F.col("k") == F.col("rk"), join.KINDS[how]).drop("rk")
        assert sorted(map(str, join.salted(a, b, "k", 4, how).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError):
        join.salted(a, b, "k", 4, "full")


def test_not_in_and_mark(spark):
    a, b = sides(spark)
    assert join.not_in(a, b, "k", "rk").count() == 0  # it holds a null
    assert join.not_in(a, b.where("rk = 1"), "k", "rk").count() == 2
    assert join.not_in(a, b.where("false"), "k", "rk").count() == 4
    assert {(r.x, r.mark) for r in join.mark(a, b, [("k", "rk")]).collect()} == {("a", True), ("b", True), ("c", True), ("d", None)}
    assert {(r.x, r.mark) for r in join.mark(a, b.where("rk = 1"), [("k", "rk")]).collect()} == {("a", True), ("b", False), ("c", False), ("d", None)}
    assert {r.mark for r in join.mark(a, b.where("false"), [("k", "rk")]).collect()} == {False}


@pytest.mark.parametrize("also", [None, "r.w > l.w"])
def test_mark_compares_equal_keys_only(spark, also):
    a = spark.range(100).selectExpr("id AS a", "id % 7 AS b", "id AS w")
    b = spark.range(100).selectExpr("id * 2 AS c", "id % 7 AS d", "id * 3 AS w")
    df = join.mark(a, b, [("a", "c"), ("b", "d")], also)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.a for r in df.collect() if r.mark} == {x for x in range(0, 100, 2) if x % 7 == x // 2 % 7 and (not also or x // 2 * 3 > x)}
    assert [r.mark for r in join.mark(a.where("a = 1"), b.where("false"), [("a", "c"), ("b", "d")], also).collect()] == [False]


def test_mark_by_three_values(spark):
    left = [(x, y) for x in (1, 2, None) for y in (1, 2, None)]
    equal = lambda x, y: None if x is None or y is None else x == y
    both = lambda p, q: False if p is False or q is False else None if p is None or q is None else True
    for right in ([(1, 1), (None, 2)], [(1, None), (2, 1)], [(None, None)], []):
        a, b = spark.createDataFrame(left, "a int, b int"), spark.createDataFrame(right, "c int, d int")
        for also, ok in ((None, lambda x, r: True), ("r.d >= l.b", lambda x, r: None not in (r[1], x[1]) and r[1] >= x[1])):
            values = {x: [both(equal(x[0], r[0]), equal(x[1], r[1])) for r in right if ok(x, r)] for x in left}
            want = {x: True if True in v else None if None in v else False for x, v in values.items()}
            assert {(r.a, r.b): r.mark for r in join.mark(a, b, [("a", "c"), ("b", "d")], also).collect()} == want


def test_mark_by_a_comparison_meets_a_row_a_key(spark, tmp_path):
    from basalt import plans  # noqa: F401  registers the queries
    from basalt.registry import QUERIES

    a = spark.range(600).selectExpr("IF(id % 5 = 0, NULL, id) AS c_custkey", "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN DOUBLE('NaN') WHEN 2 THEN 1e9 ELSE id * 3D END AS c_acctbal")
    for nulls in (3, 1000):  # of orders without a customer
        b = spark.range(900).selectExpr(f"IF(id % {nulls} = 0, NULL, id % 300) AS o_custkey", "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN DOUBLE('NaN') ELSE id * 50D END AS o_totalprice")
        at = tmp_path / str(nulls)
        for df, table in ((a, "customer"), (b, "orders")):
            df.write.parquet(f"{at}/{table}.parquet")
        df = QUERIES["join_mixed_mark"](spark, str(at))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ExistenceJoin") == plan.count("Aggregate [") > 2  # right's rows were met one by one
        per = a.withColumn("__i", F.monotonically_increasing_id()).crossJoin(b).where("o_totalprice > c_acctbal * 40").groupBy("__i").agg(F.max(F.expr("c_custkey = o_custkey")).alias("hit"), F.max(F.expr("c_custkey IS NULL OR o_custkey IS NULL")).alias("open"))
        want = a.withColumn("__i", F.monotonically_increasing_id()).join(per, "__i", "left").selectExpr("c_custkey", "CASE WHEN hit THEN TRUE WHEN open THEN NULL ELSE FALSE END AS m")
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
        assert {r.m for r in df.collect()} == {True, False, None}


@pytest.mark.parametrize("sign", [">", ">=", "<", "<="])
def test_mark_by_every_comparison(spark, sign):
    values = [None, 1, 2, 3]
    a = spark.createDataFrame([(x, y, v) for x in (1, 2, None) for y in (1, None) for v in values], "a int, b int, v int")
    b = spark.createDataFrame([(x, y, w) for x, y, ws in ((1, 1, (2, None)), (2, None, (1, 3)), (None, 1, (2,)), (None, None, (None,))) for w in ws], "c int, d int, w int")
    one, other = (join.mark(a, b, [("a", "c"), ("b", "d")], also) for also in (("r.w", sign, "l.v"), f"r.w {sign} l.v"))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    with pytest.raises(ValueError):
        join.mark(a, b, [("a", "c")], ("r.w", "=", "l.v"))


def test_salts_go_to_hot_keys_alone(spark):
    a = spark.createDataFrame([(1, i) for i in range(500)] + [(k, 0) for k in range(2, 100)], "k int, v int")
    b = spark.createDataFrame([(k, "x") for k in range(100)], "k int, w string")
    both = join.salted(a, b, "k", 8, share=10)
    assert both.count() == 598
    assert "__salt" not in both.columns


def test_as_of_by_eras(spark):
    from bisect import bisect_right

    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    right = [("a", day(d, h), 10 * d + h) for d in (1, 2, 9) for h in (0, 5)] + [("b", day(3, 3), 7), ("b", day(3, 3), 9), ("a", None, 5), (None, day(1, 1), 6), ("c", day(1, 1), None)]
    left = [(k, day(d, h), n) for n, (k, d, h) in enumerate((k, d, h) for k in ("a", "b", "c", "d", None) for d in (1, 2, 5, 9, 20) for h in (0, 3, 23))] + [("a", None, 99)]
    found = {r.n: r.v for r in join.as_of(spark.createDataFrame(left, "k string, t timestamp, n int"), spark.createDataFrame(right, "k string, t timestamp, v int"), "k", "t", "v").collect()}
    for k, t, n in left:
        past = sorted(((rt, v if v is not None else -1) for rk, rt, v in right if rk == k and rk is not None and rt is not None))
        at = bisect_right([rt for rt, _ in past], t) if t is not None else 0
        want = past[at - 1][1] if at else None
        assert found[n] == (None if want == -1 else want), (k, t)
    with pytest.raises(ValueError):
        join.as_of(spark.createDataFrame([("a", day(1, 1), 1)], "k string, t timestamp, v int"), spark.createDataFrame(right, "k string, t timestamp, v int"), "k", "t", "v")


def test_times_know_no_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    t = F.lit(datetime.datetime(2024, 3, 31, 2, 30, 5, 600_000)).cast("timestamp_ntz")  # an hour that Berlin skips
    want = spark.range(1).select(*[X.date_trunc(u, t).alias(u) for u in ("week", "day", "hour", "minute", "second", "millisecond")], X.microsecond(t).alias("us")).collect()[0]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        t = F.lit("2024-03-31 02:30:05.6").cast("timestamp_ntz")
        found = spark.range(1).select(*[X.date_trunc(u, t).alias(u) for u in ("week", "day", "hour", "minute", "second", "millisecond")], X.microsecond(t).alias("us")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == want and found.us == 5_600_000 and found.hour == datetime.datetime(2024, 3, 31, 2)


def test_running_sums_are_carried_over_ranges(spark):
    rows = [(None if k % 7 == 0 else k % 3, k, None if k % 11 == 0 else k * 3 - 500) for k in range(2000)]
    df = spark.createDataFrame(rows, "g int, k int, v int").repartition(5)
    found = window.running_sum(df, ["g"], ["k"], "v", "s")
    sums: dict = {}
    want = set()
    for g, k, v in rows:
        sums[g] = sums.get(g) if v is None else (sums.get(g) or 0) + v
        want.add((g, k, v, sums[g]))
    assert {tuple(r) for r in found.collect()} == want
    assert window.running_sum(df.where("false"), ["g"], ["k"], "v").count() == 0


def test_schemas_follow_what_is_written(spark, tmp_path):
    from basalt.catalog import read

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert read(spark, path).columns == ["id"] == read(spark, path).columns
    spark.range(3).selectExpr("id", "id AS k").write.parquet(path, mode="overwrite")
    assert read(spark, path).columns == ["id", "k"]


def test_only_small_sides_are_broadcast(spark, data):
    nation = spark.read.parquet(f"{data}/nation.parquet")
    assert "broadcast" in join.small(nation)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in join.small(nation, 1)._jdf.queryExecution().logical().toString().lower()


def test_top_n_is_one_operator(spark, data):
    df = order.top_n(spark.read.parquet(f"{data}/orders.parquet"), 5, "-o_totalprice")
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_reaches_the_reader(spark, data):
    df = scan.scan(spark, f"{data}/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 49)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49" in plan and "l_extendedprice" not in plan


def test_cache_levels(spark):
    df = spark.range(3)
    assert scan.cached(df, "none") is df
    assert scan.cached(spark.range(4), "table_host").is_cached
    with pytest.raises(KeyError):
        scan.cached(df, "tape")
    with scan.kept(spark.range(5)) as five:
        assert five.is_cached and five.count() == 5
    assert not five.is_cached
    assert scan.one_row(spark).count() == 1 and scan.empty(df).count() == 0
    assert scan.values(spark, [(None,), (2,)], "a int").count() == 2


@pytest.mark.parametrize("kind", ["csv", "tsv", "tbl"])
def test_delimited_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    files.write_delimited(df, str(tmp_path / kind), kind)
    assert sorted(files.read_delimited(spark, str(tmp_path / kind), "k int, s string", kind).collect()) == sorted(df.collect())


def test_lines_that_end_with_the_separator(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("0|AFRICA|x|\n1|ASIA|y|\n")
    assert files.read_delimited(spark, str(tmp_path / "r.tbl"), "k int, n string, c string", "tbl").collect() == [(0, "AFRICA", "x"), (1, "ASIA", "y")]


def test_partitioned_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    files.write_parquet(df, str(tmp_path / "p"), ["s"])
    assert files.read_parquet(spark, str(tmp_path / "p")).where("s = 'b'").select("k").collect() == [(2,)]


def test_streams_agree_with_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = windows.tumbling(events, "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", ["event_type"], F.count("*").alias("n"), late="400 days")
    q = stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, batch.collect()))


def test_stream_run_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 1), (datetime.datetime(2024, 1, 1), 1), (datetime.datetime(2024, 1, 2), 2)], "ts timestamp, k int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = windows.deduplicate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "k", late="10 days")
        windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("kind", ["sliding", "sessions"])
def test_other_windows_as_streams(spark, data, tmp_path, kind):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    late = events.agg(F.max("ts")).collect()[0][0] + datetime.timedelta(days=900)
    spark.createDataFrame([(late, -1, -1)], "ts timestamp_ntz, user_id long, event_id long").write.parquet(str(tmp_path / "in"), mode="append")

    def windowed(df):
        n = F.count("*").alias("n")
        return windows.sliding(df, "ts", "2 days", "1 day", [], n, late="400 days") if kind == "sliding" else windows.sessions(df, "ts", "6 hours", ["user_id"], n, late="400 days")

    q = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(kind).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(str, spark.table(kind).collect())) == sorted(map(str, windowed(events).collect()))  # all windows but those of the last event are closed


def test_bucketed_tables_move_no_row(spark, data):
    from basalt.registry import QUERIES

    plan = QUERIES["sink_bucketed"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_jdbc_reads_in_ranges(spark, data):
    from basalt.registry import QUERIES

    assert QUERIES["source_jdbc"](spark, data).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("pairs", [1 << 28, 1 << 8])
def test_band_join_of_odd_values(spark, monkeypatch, how, pairs):
    monkeypatch.setattr(join, "_PAIRS", pairs)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 1e300, 2.5, 2.5]
    a = spark.createDataFrame(list(enumerate(odd + [k % 37 / 4 for k in range(150)] + [3.0] * 50)), "i int, x double")
    b = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate([(p, q) for p in odd for q in odd] + [(k % 50 / 3 - 5, k % 50 / 3 - 5 + k % 3 * 0.3) for k in range(100)])], "j int, lo double, hi double")
    df = join.band(a, b, "x", "lo", "hi", how)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    want = a.join(b, F.expr("x BETWEEN lo AND hi"), how)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    none = join.band(a.where("x IS NULL"), b, "x", "lo", "hi", how).collect()
    assert sorted(map(str, none)) == sorted(map(str, a.where("x IS NULL").join(b, F.lit(False), how).collect()))


def test_band_join_spreads_rows_before_copying_them_to_slices(spark, monkeypatch):
    monkeypatch.setattr(join, "_PAIRS", 1 << 11)
    monkeypatch.setattr(join, "_COPIES", 1 << 12, raising=False)
    a = spark.range(500).selectExpr("id AS i", "id / 10D AS x")
    for reached, makers in ((40, 0), (400, 75)):  # by 64 cells and 1 or 12 slices
        b = spark.range(400).coalesce(1).selectExpr("id AS j", f"IF(id < {reached}, 0D, 1e6) AS lo", f"IF(id < {reached}, 24.9D, 2e6) AS hi")
        df = join.band(a, b, "x", "lo", "hi")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"RoundRobinPartitioning\((\d+)\)", plan) == [str(makers)] * (makers > 0)
        assert df.agg(F.count("*"), F.countDistinct("i", "j"), F.max("i"), F.max("j")).collect() == [(250 * reached, 250 * reached, 249, reached - 1)]


def test_pairs_of_equal_keys_are_counted_in_tasks_of_bounded_rows(spark, tmp_path):
    from basalt.registry import QUERIES

    rows = spark.range(1 << 21).selectExpr("IF(id % 2 = 0, 7, id) AS l_orderkey", "IF(id = 1, NULL, 3) AS l_linenumber")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES["join_multi_key"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 8  # of 4 shuffle partitions otherwise
    assert df.agg(F.count("*"), F.max("n")).collect() == [((1 << 20) - 1, ((1 << 20) + 1) ** 2)]


@pytest.mark.parametrize("rows", [1 << 17, 5])
def test_ranks_of_peers_spread_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(window, "_ROWS", rows)
    values = [(k, None if k % 11 == 0 else "ab"[k % 7 > 4], None if k % 13 == 0 else 1 if k % 3 else k % 5, k % 4) for k in range(120)]
    df = spark.createDataFrame(values, "k long, g string, v int, t int")
    got = window.ranks(df, ["g"], ["-v"], ["t", "k"])
    assert got.columns == ["k", "g", "v", "t", "rank", "dense", "number"]
    text = "SELECT k, g, v, t, rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY g ORDER BY v DESC NULLS LAST, t, k) AS number FROM {df} WINDOW w AS (PARTITION BY g ORDER BY v DESC NULLS LAST)"
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.sql(text, df=df).collect()))
    assert sorted(map(str, window.running_sum(df, ["g"], ["k"], "v").collect())) == sorted(map(str, spark.sql("SELECT *, sum(v) OVER (PARTITION BY g ORDER BY k) AS running FROM {df}", df=df).collect()))


def test_window_rank_is_spread_over_tasks(spark, tmp_path):
    from basalt.registry import QUERIES

    rows = spark.range(600_000).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "id % 1000 / 10.0D AS o_totalprice", "IF(id % 9 = 0, NULL, '1-URGENT') AS o_orderpriority")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES["window_rank"](spark, str(tmp_path))
    most = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]
    assert most < 600_000
    assert df.agg(F.max("r"), F.max("d"), F.max("n"), F.count_distinct("n")).collect() == [(533_334, 2, 600_000, 600_000)]  # nulls are last


def test_derby_is_read_from_another_process(spark):
    rows = [(1, "a", 0.5, 7), (2, None, None, None), (None, "c", 1.5, 1 << 40)]
    url = files.save_derby(spark.createDataFrame(rows, "i int, s string, d double, n long"), "t")
    assert sorted(map(tuple, files.read_jdbc(spark, url, "t", "i", (0, 4), 2, driver=files.DERBY).collect()), key=str) == sorted(rows, key=str)
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    found = subprocess.run(["java", "-Dderby.stream.error.file=/dev/null", "-cp", jars, "org.apache.derby.tools.ij"], input=f"connect '{url}'; select count(*) * 100 + sum(i) from t;", capture_output=True, text=True, timeout=120)
    assert " 303" in f" {' '.join(found.stdout.split())}", found.stdout  # while this process has it open


def test_tpch_scans_lineitem_once(spark, data):
    from basalt.registry import QUERIES

    for name in ("tpch_q01", "tpch_q02", "tpch_q20"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1, name


def test_engine_options(spark, data):
    engine = Engine(spark, data, ["nation"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    engine.set("scan_task_batch_size", "64 MiB")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(64 << 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    engine.set("scan_cache_level", "table_host")
    assert "InMemoryTableScan" in engine.explain("SELECT n_name FROM nation")
    engine.close()
    assert "InMemoryTableScan" not in engine.explain("SELECT n_name FROM nation")
    for option, value, error in (("scan_cache_level", "tape", ValueError), ("no_such", 1, KeyError), ("processing_memory", "1 GB", ValueError)):
        with pytest.raises(error):
            engine.set(option, value)


def test_scalar_subqueries_of_many_rows_fail(spark, data):
    engine = Engine(spark, data, ["nation", "region"])
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        engine.execute("SELECT (SELECT n_name FROM nation) AS x FROM region").collect()
