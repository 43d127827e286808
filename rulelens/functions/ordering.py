"""Ordered computations that stay distributed: no window ever spans more than one value range.

A plain ``Window.partitionBy(group).orderBy(value)`` puts a whole group in one task, which fails when a
group holds a third of the table.  The helpers here pre-aggregate, cut the value axis (or the hash axis) in
ranges, order inside a range, and add the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulelens.functions.hashing import order_key
from rulelens.functions.lineage import cut

MAX_RANGES = 4096
BROADCAST_GROUPS = 1000  # at most 32 MB of cut points
SMALL_ROWS = 4_000_000  # narrow rows; a counted table this small is ordered by plain windows


def _range_steps(df: DataFrame) -> int:
    """log2 of the number of ranges, following the session's shuffle parallelism."""
    wanted = min(MAX_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, (wanted - 1).bit_length())


def _range_of(value: Column, cuts: Column, steps: int) -> Column:
    """Number of cuts below ``value``, found by halving (the cuts array has 2**steps - 1 entries)."""
    strides = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    return F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.element_at(cuts, at + s) < value, at + s).otherwise(at))


def with_value_range(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "value_range") -> DataFrame:
    """Add the number of the value range each row falls in, about evenly filled inside each group."""
    by, steps = list(by), _range_steps(df)
    shares = [k / (1 << steps) for k in range(1, 1 << steps)]
    found = F.percentile_approx(value, shares, 1000).alias("__cuts")
    if by:
        cuts = cut(df.groupBy(*by).agg(found))
        # few groups: their cuts travel to the rows; many groups: the rows spread over the groups anyway
        tagged = df.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_GROUPS else cuts, by)
    else:
        only = df.agg(found).first()["__cuts"]  # at most MAX_RANGES numbers
        if not only:
            return df.withColumn(name, F.lit(0))
        tagged = df.withColumn("__cuts", F.lit(only))
    # Generated rather than projected: joins on a projected lambda infer filters on the wrong side (Spark 4.1).
    return tagged.withColumn(name, F.explode(F.array(_range_of(F.col(value), F.col("__cuts"), steps)))).drop("__cuts")


def running_sums(df: DataFrame, value: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False,
                 following: Sequence[str] = (), totals: dict[str, str] | None = None, written: bool = False) -> DataFrame:
    """Inclusive running sums over one-row-per-(by, value) input.

    ``sums`` maps an output name to the summed column, ``totals`` does the same for whole-group sums, and
    ``following`` names columns whose value in the next row is wanted as ``next_*``.  ``written`` says that the
    input is already a written table.
    """
    by, totals = list(by), totals or {}
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    # The grouped table is read several times below, so it is written once; that also gives its size.
    df = df.filter(F.col(value).isNotNull())
    df = df if written else cut(df)
    if df.count() <= SMALL_ROWS:
        whole = Window.partitionBy(*(by or [F.lit(0)]))
        inside = whole.orderBy(direction(value))
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(c).over(upto).alias(o) for o, c in sums.items()], *[F.sum(c).over(whole).alias(o) for o, c in totals.items()],
                         *[F.lead(c).over(inside).alias(f"next_{c}") for c in following])
    ranged = with_value_range(df, value, by)
    pick_first = F.max_by if descending else F.min_by
    per_range = ranged.groupBy(*by, "value_range").agg(
        *[F.sum(c).alias(f"__t_{o}") for o, c in {**sums, **totals}.items()], *[pick_first(c, value).alias(f"__f_{c}") for c in following])
    group = Window.partitionBy(*(by or [F.lit(0)]))  # at most MAX_RANGES rows per group
    ranges = group.orderBy(direction("value_range"))
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*by, "value_range", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums],
                               *[F.sum(f"__t_{o}").over(group).alias(f"__g_{o}") for o in totals], *[F.lead(f"__f_{c}").over(ranges).alias(f"__n_{c}") for c in following])
    if not by:  # at most MAX_RANGES rows: cheaper as a literal table than as a self-join
        offsets = F.broadcast(df.sparkSession.createDataFrame(offsets.collect(), offsets.schema))
    inside = Window.partitionBy(*by, "value_range").orderBy(direction(value))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*by, "value_range"])
    return joined.select(*df.columns, *[(F.sum(c).over(upto) + F.col(f"__o_{o}")).alias(o) for o, c in sums.items()], *[F.col(f"__g_{o}").alias(o) for o in totals],
                         *[F.coalesce(F.lead(c).over(inside), F.col(f"__n_{c}")).alias(f"next_{c}") for c in following])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


ACCURACY = 1000  # approximate ranks that give the brackets are off by at most a share of one in so many
MARGIN = 4 / ACCURACY  # ranks on either side of a wanted one that its bracket takes in


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size; one row per group, one column per entry of ``probs``.

    Rows are selected by brackets: mergeable sketches give for every wanted rank two values that surely enclose it; a second pass
    counts what lies below and keeps the few values inside, which alone are put in order.  With ``weight`` the input is already
    (by, value, count) and is ordered as it is.
    """
    by = list(by)
    if weight:
        return _ordered_quantiles(df, value, probs, by, weight)
    rows = df.select(*by, F.col(value).alias("__v")).filter("__v IS NOT NULL")
    ends = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-MARGIN, MARGIN)]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"), F.percentile_approx("__v", ends, ACCURACY).alias("__ends"))
    brackets = cut(found)  # one row a group
    few = brackets.count() <= BROADCAST_GROUPS
    same = [rows[c].eqNullSafe(brackets[c]) for c in by]
    beside = rows.join(F.broadcast(brackets) if few else brackets, reduce(lambda a, b: a & b, same) if same else F.lit(True)).select(*[rows[c] for c in by], "__v", "__ends", "__total")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("__ends", 2 * i + 1).alias("lo"), F.element_at("__ends", 2 * i + 2).alias("hi")) for i in range(len(probs))]))
    near = beside.select(*by, "__v", "__total", wanted.alias("__b")).filter(F.col("__v") <= F.col("__b.hi"))
    inside = F.when(F.col("__v") >= F.col("__b.lo"), F.col("__v"))  # all that lies below becomes one count
    counts = near.groupBy(*by, F.col("__b.i").alias("__i"), inside.alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.first("__total").alias("__total"))
    upto = Window.partitionBy(*by, "__i").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)  # a bracket's values
    cum = counts.withColumn("__cum", F.sum("__n").over(upto)).filter("__v IS NOT NULL")
    picks, finals = [], []
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        mine = F.col("__i") == i
        picks += [
            F.min(F.when(mine & (F.col("__cum") > F.floor(at)), F.col("__v"))).alias(f"__lo_{name}"),
            F.min(F.when(mine & (F.col("__cum") > F.ceil(at)), F.col("__v"))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__fr_{name}"),
        ]
        lo, hi, fr = (F.col(f"__{k}_{name}") for k in ("lo", "hi", "fr"))
        finals.append((lo + (hi - lo) * fr).alias(name))
    return cum.groupBy(*by).agg(*picks).select(*by, *finals)


def _ordered_quantiles(counts: DataFrame, value: str, probs: dict[str, float], by: list[str], n: str) -> DataFrame:
    cum = running_sums(counts.select(*by, value, n), value, {"__cum": n}, by, totals={"__total": n})
    total = F.col("__total")
    picks, finals = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (total - 1)
        picks += [
            F.min(F.when(F.col("__cum") > F.floor(at), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") > F.ceil(at), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__fr_{name}"),
        ]
        lo, hi, fr = (F.col(f"__{k}_{name}") for k in ("lo", "hi", "fr"))
        finals.append((lo + (hi - lo) * fr).alias(name))
    return cum.groupBy(*by).agg(*picks).select(*by, *finals)


def average_ranks(counts: DataFrame, value: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Mid-rank of every distinct value; input is one row per (by, value) with its count."""
    return running_sums(counts, value, {"__cum": n}, by).withColumn(
        "avg_rank", F.col("__cum") - (F.col(n) - 1) / F.lit(2.0)
    ).drop("__cum")


def with_hash_rank(df: DataFrame, seed, key: Sequence[str], by: Sequence[str] = (), name: str = "hash_rank") -> DataFrame:
    """Exact position (1-based) of each row in pseudo-random order inside its group.

    The hash space is cut by leading hex digits, so even one huge group is ordered by many tasks.
    """
    by = list(by)
    digits = 1 if _range_steps(df) <= 5 else 2 if _range_steps(df) <= 9 else 3
    keyed = df.withColumn("__key", order_key(seed, *key)).withColumn("__slot", F.substring("__key", 1, digits))
    counts = keyed.groupBy(*by, "__slot").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__slot", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slot").orderBy("__key", *key)
    ranked = keyed.join(offsets, [*by, "__slot"]).withColumn(name, (F.row_number().over(inside) + F.col("__before")).cast("long"))
    return ranked.drop("__key", "__slot", "__before")


def first_by_hash(df: DataFrame, seed, key: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows that ``with_hash_rank`` puts first: a task keeps as many, and no other row is ordered."""
    return df.withColumn("__key", order_key(seed, *key)).orderBy("__key", *key).limit(n).drop("__key")


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), salt: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """Exact best ``k`` rows per group: first inside salted slices of the group, then over the survivors."""
    by = list(by)
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*(salt or df.columns)), F.lit(salts)))
    first = Window.partitionBy(*by, "__slice").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    survivors = sliced.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k)
    return survivors.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).drop("__r", "__slice")


def quantile_grid(counts: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], weight: str = "n", written: bool = False) -> DataFrame:
    """(by, prob, quantile) for evenly spaced probabilities at once; interpolated linearly, input is (by, value, weight)."""
    by, m = list(by), len(probs)
    start, step = float(probs[0]), (float(probs[-1]) - float(probs[0])) / (m - 1) if m > 1 else 1.0
    if any(abs(p - (start + step * i)) > 1e-9 for i, p in enumerate(probs)):
        raise ValueError("probabilities must be evenly spaced")
    cum = running_sums(counts.select(*by, value, weight), value, {"__cum": weight}, by, totals={"__total": weight}, written=written)
    first, last, top = F.col("__cum") - F.col(weight), F.col("__cum") - 1, F.greatest(F.col("__total") - 1, F.lit(1))
    # the probabilities whose rank falls on this value or right beside it
    low = F.greatest(F.lit(0), F.floor(((first - 1) / top - start) / step)).cast("int")
    high = F.least(F.lit(m - 1), F.ceil(((last + 1) / top - start) / step)).cast("int")
    near = cum.filter(low <= high).withColumn("__i", F.explode(F.sequence(low, high)))
    exact = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1)
    at = F.col("prob") * (F.col("__total") - 1)
    hit = near.withColumn("prob", exact).filter(F.floor(at).between(first, last) | F.ceil(at).between(first, last))
    ends = hit.groupBy(*by, "prob").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max(at - F.floor(at)).alias("__fr"))
    return ends.select(*by, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__fr")).alias("quantile"))
