"""Joins of every kind, and the choice of how large a side may be to be sent to all executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if the estimate of its size allows; otherwise the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; right_semi and right_anti keep rows of the right side."""
    if how in ("right_semi", "right_anti"):
        return right.join(left, on, KINDS[how.removeprefix("right_")])
    return left.join(right, on, KINDS[how])


def equi(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", also: Column | None = None, nulls_match: bool = False) -> DataFrame:
    """Equal keys, with a further condition evaluated in the join; null keys match only if asked to."""
    on = None
    for a, b in keys:
        one = left[a].eqNullSafe(right[b]) if nulls_match else left[a] == right[b]
        on = one if on is None else on & one
    return join(left, right, on if also is None else on & also, how)


def mark(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], also: str | tuple[str, str, str] | None = None, name: str = "mark") -> DataFrame:
    """left with a column that says whether (keys of left) IN (keys of right), right's rows being those that meet `also`.

    SQL's three values: true for a match; null without one if a row of right differs only where a key is null; else
    false.  `also` is a condition in SQL on columns of l and r, or a comparison in three parts: SQL on r, one of > >= < <=,
    and SQL on l, whose values must compare as r's sort.

    A job finds in which keys either side holds nulls together.  Rows of one such pattern each meet those of another by the
    keys that neither lacks, so every join is on equal keys, but with a condition for rows that have none left to compare.
    Of a comparison right's greatest or least value for the same keys decides, so a left row meets one row at most.
    """
    if isinstance(also, tuple) and also[1] not in (">", ">=", "<", "<="):
        raise ValueError("a comparison is by one of > >= < <=")
    every = range(len(keys))

    def null(side: int, pattern: int) -> str:
        """The rows of a side (0 or 1) whose keys are null in this pattern of bits, and in no other."""
        return " AND ".join(f"{'lr'[side]}.`{keys[k][side]}` IS {'' if pattern >> k & 1 else 'NOT '}NULL" for k in every)

    def patterns(df: DataFrame, side: int) -> list[int]:
        bits = [F.when(df[keys[k][side]].isNull(), 1 << k).otherwise(0) for k in every]
        return sorted(r[0] for r in df.select(sum(bits[1:], bits[0]).alias("p")).distinct().collect())

    def exists(p: int, q: int) -> str:
        """A row of right's pattern q with those keys equal that are null neither in p nor in q."""
        kept = [k for k in every if not (p | q) >> k & 1]
        terms = [f"l.`{keys[k][0]}` = r.`{keys[k][1]}`" for k in kept]
        once = ", ".join(f"r.`{keys[k][1]}`" for k in kept)
        if isinstance(also, tuple):
            value, sign, other = also
            best = f"{'max' if '>' in sign else 'min'}({value}) AS `__best`"
            best = f"SELECT {once}, {best} FROM {{right}} r WHERE {null(1, q)} GROUP BY {once}" if kept else f"SELECT {best} FROM {{right}} r WHERE {null(1, q)}"
            return f"EXISTS (SELECT 1 FROM ({best}) r WHERE {' AND '.join([*terms, f'r.`__best` {sign} ({other})'])})"
        if also:
            return f"EXISTS (SELECT 1 FROM {{right}} r WHERE {' AND '.join([null(1, q), *terms, f'({also})'])})"
        if not kept:
            return "TRUE"
        return f"EXISTS (SELECT 1 FROM (SELECT DISTINCT {once} FROM {{right}} r WHERE {null(1, q)}) r WHERE {' AND '.join(terms)})"

    rights = patterns(right, 1)
    parts = []
    for p in patterns(left, 0):
        same = exists(0, 0) if p == 0 and 0 in rights else "FALSE"
        unknown = [exists(p, q) for q in rights if p | q]
        unknown = "TRUE" if "TRUE" in unknown else " OR ".join(unknown) or "FALSE"
        text = f"SELECT l.*, CASE WHEN {same} THEN TRUE WHEN {unknown} THEN CAST(NULL AS BOOLEAN) ELSE FALSE END AS `{name}` FROM {{left}} l WHERE {null(0, p)}"
        parts.append(left.sparkSession.sql(text, left=left, right=right) if "{right}" in text else left.sparkSession.sql(text, left=left))
    return reduce(DataFrame.unionAll, parts) if parts else left.withColumn(name, F.lit(None).cast("boolean"))


_CELLS, _PAIRS = 64, 1 << 28  # of a band join: ranges of left's values; pairs with right's rows in reach, an 8th for a slice of a cell, a 32nd for a task
_COPIES = 1 << 20  # of a band join's right rows, one for each cell and slice, that a task makes


def _cell(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are at or below x, found by halving; it never falls as x rises."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < bounds[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    return F.when(x.isNotNull(), among(0, len(bounds)))


def band(left: DataFrame, right: DataFrame, x: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """Rows whose x (SQL on left) lies between low and high (SQL on right), ends included; inner, left or full.

    Left's values are cut into cells of about equally many rows.  A left row goes to its cell, a right row to each cell that
    its range touches, so whole cells lie inside of a range but for its two ends, and little more is compared than comes out.
    Cells are dealt out in slices of left as both sides grow, and tasks with the product of left's rows and right's in reach
    of any: a task streams its left rows past a cell's right rows.  Right's rows are spread out before they are copied to slices.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError("a band join is inner, left or full")
    value = F.expr(x).cast("double")
    found = left.agg(F.count("*"), F.min(value), F.max(value), F.percentile_approx(F.when(~F.isnan(value), value), [k / _CELLS for k in range(1, _CELLS)], 1000)).collect()[0]
    bounds = sorted({b for b in found[3] or [] if abs(b) != float("inf")})
    b = right.withColumn("__low", F.expr(low).cast("double")).withColumn("__high", F.expr(high).cast("double"))
    near = b.where((F.col("__low") <= F.col("__high")) & (F.col("__high") >= F.lit(found[1])) & (F.col("__low") <= F.lit(found[2])))
    reach = near.count()
    pairs = found[0] * reach
    slices = min(max(pairs // (_CELLS * (_PAIRS >> 3)), 1), 64)
    tasks = min(max(pairs // (_PAIRS >> 5), 1), 1024)
    makers = min(reach * _CELLS * slices // _COPIES, 1024)
    near = near.repartition(makers) if makers > 1 else near
    a = left.withColumn("__x", value).withColumn("__cell", _cell(F.col("__x"), bounds)).withColumn("__slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)))
    spread = near.withColumn("__c", F.explode(F.sequence(_cell(F.col("__low"), bounds), _cell(F.col("__high"), bounds)))).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    a, spread = a.repartition(tasks, "__cell", "__slice"), spread.repartition(tasks, "__c", "__s")
    on = (F.col("__cell") == F.col("__c")) & (F.col("__slice") == F.col("__s")) & F.col("__x").between(F.col("__low"), F.col("__high"))
    out = a.join(spread.hint("merge"), on, "inner" if how == "inner" else "left").select(*left.columns, *right.columns)
    if how != "full":
        return out
    alone = right.select(F.struct(*right.columns).alias("__row"), F.expr(low).cast("double").alias("__low"), F.expr(high).cast("double").alias("__high"))
    return out.unionByName(_outside(left.select(value.alias("__x")).where("__x IS NOT NULL").distinct(), alone, bounds).select("__row.*"), allowMissingColumns=True)


def _outside(values: DataFrame, right: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Right's rows between whose __low and __high there is no __x of values: the least __x from __low on lies beyond __high."""
    first = {r[0]: r[1] for r in values.groupBy(_cell(F.col("__x"), bounds)).agg(F.min("__x")).collect()}  # at most a row a cell
    later = [next((first[k] for k in range(c + 1, len(bounds) + 1) if k in first), None) for c in range(len(bounds) + 1)]
    slices = min(1 + right.count() // max(_PAIRS >> 2, 1), 64)
    marks = values.select(F.col("__x").alias("__at"), "__x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("__slice"))
    asked = right.withColumn("__at", F.col("__low")).withColumn("__slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)))
    both = asked.unionByName(marks, allowMissingColumns=True).withColumn("__cell", _cell(F.col("__at"), bounds))
    following = Window.partitionBy("__cell", "__slice").orderBy(F.desc("__at"), F.col("__x").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    least = both.withColumn("__least", F.last("__x", ignorenulls=True).over(following)).where("__row IS NOT NULL")
    after = F.get(F.array(*[F.lit(v).cast("double") for v in later]), F.col("__cell"))
    inside = (F.col("__low") <= F.col("__high")) & (F.coalesce("__least", after) <= F.col("__high"))
    return least.where(~F.coalesce(inside, F.lit(False)))


def not_in(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """SQL's NOT IN: nothing if right holds a null, and no row whose key is null unless right is empty."""
    nulls = right.agg(F.count("*").alias("__n"), F.count(F.when(F.col(other).isNull(), 1)).alias("__nulls"))  # one row
    rest = left.join(right.select(F.col(other).alias("__key")), left[key] == F.col("__key"), "left_anti")
    return rest.join(F.broadcast(nulls), (F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull()), "left_semi")


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner", share: int = 64) -> DataFrame:
    """Equal keys where a few keys of left hold many rows: those over one in `share` of all rows are dealt to `salts` tasks each.

    Right's rows of these keys alone go to all of them.  There are fewer than `share` such keys, so they can be broadcast.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError("the salted side must be the one that is kept")
    total = left.count()
    hot = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).count().where(F.col("count") * share > total).select("__hot")
    marked = lambda df: df.join(F.broadcast(hot), df[key] == F.col("__hot"), "left")
    a = marked(left).withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)).drop("__hot")
    b = marked(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot").isNotNull(), salts - 1).otherwise(0)).cast("array<bigint>"))).drop("__hot").withColumnRenamed(key, "__key")
    return a.join(b, (a[key] == b["__key"]) & (a["__salt"] == b["__salt"]), KINDS[how]).drop("__salt", "__key")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str, era: Callable[[Column], Column] = F.to_date) -> DataFrame:
    """Each left row with the right side's latest value at or before its time, of several at one time the largest; null where there is none.

    A key's history is sorted in pieces, by `era` (a function of the time that never falls as the time rises): a key of which a third of all rows
    are is spread over as many tasks as it has eras.  What an era begins with is carried over from a small table of last values.
    """
    if value in left.columns:
        raise ValueError(f"left has a column {value} of its own")
    own = [F.col(f"`{c}`") for c in left.columns]
    a = left.select(F.struct(*own).alias("__row"), F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(1).alias("__side"))
    b = right.select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__value")).where("__by is not null and __time is not null")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__era", era(F.col("__time")))
    latest = F.last("__value", ignorenulls=True).over(Window.partitionBy("__by", "__era").orderBy("__time", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("__by", "__era").agg(F.max(F.when(F.col("__side") == 0, F.struct("__time", "__value"))).alias("__end"))
    before = Window.partitionBy("__by").orderBy("__era").rowsBetween(Window.unboundedPreceding, -1)  # a row an era
    carried = ends.select(F.col("__by").alias("__k"), F.col("__era").alias("__e"), F.last("__end.__value", ignorenulls=True).over(before).alias("__carried"))
    found = both.withColumn("__latest", latest).where("__side = 1")
    joined = found.join(carried, (F.col("__by") == F.col("__k")) & (F.col("__era") == F.col("__e")), "left")
    return joined.select("__row.*", F.coalesce("__latest", "__carried").getField("v").alias(value))
