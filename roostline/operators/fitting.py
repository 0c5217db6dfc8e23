"""Double-exponential fits of survivor curves.

The unit of work is one key's runs: the distinct interval lengths of that key, at
most ``sqrt(2 * span)`` rows however many visits there are (see
``intervals.interval_histogram``). They are gathered into one row per key, each start of
each plan becomes a row of its own, and the tasks take the searches of many keys and starts side by side
(see ``least_squares``): one job, nothing through the driver, any number of keys. Starts, gathering, choice,
goodness of fit and everything else are Spark expressions.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline.functions import curves
from roostline.functions.curves import LOG_FLOOR
from roostline.operators.least_squares import CONVERGED, HOPELESS, STALLED, Points, search

# The functions below travel to the executors themselves, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Points that are searched over at once in a task.
AT_ONCE = 500_000

PARAMETERS = ("a1", "l1", "a2", "l2")
FREE = (-math.inf,) * 4, (math.inf,) * 4

# Start points, bounds and limits whose results have to agree.
SITE_START = (0.4, 0.5, 0.6, 0.02)
SPECIES_STARTS = (  # amplitude, rate * mean, amplitude, rate * mean
    (0.8, 1.0, 0.2, 0.01),
    (0.6, 0.5, 0.4, 0.05),
    (0.9, 2.0, 0.1, 0.001),
    (0.5, 0.1, 0.5, 0.1),
)
SPECIES_BOUNDS = (0.01, 0.001, 0.01, 0.0001), (1.0, 50.0, 1.0, 10.0)
BREAK_SHARE = 0.3
BREAK_START = (0.8, 3.0, 0.2, 0.05)
BREAK_BOUNDS = (0.0, 0.01, 0.0, 0.001), (1.0, 20.0, 1.0, 1.0)
MIN_R2 = 0.5
MIN_POINTS = 10
SITE_ROUNDS = 10_000
SPECIES_ROUNDS = 20_000
BREAK_ROUNDS = 15_000

# Two equal components have equal derivatives; this parts them the same way every time.
SYMMETRY_BREAK = 1e-3


@dataclass(frozen=True)
class FitPlan:
    """What to fit.

    ``starts`` hold rates as they are, or, with ``rate_scale``, as multiples of
    ``1 / (rate_scale * mean interval)``. Starts outside the bounds are skipped and
    the first converged one with R2 above ``min_r2`` wins.
    """

    log_space: bool
    starts: tuple[tuple[float, ...], ...]
    rate_scale: float | None = None
    bounds: tuple[tuple[float, ...], tuple[float, ...]] = FREE
    min_r2: float | None = None
    min_points: int = 4
    max_rounds: int = SITE_ROUNDS


LINEAR_PER_SITE = FitPlan(log_space=False, starts=(SITE_START,))
LOG_PER_SITE = FitPlan(log_space=True, starts=(SITE_START,))
LOG_PER_SPECIES = FitPlan(
    log_space=True, starts=SPECIES_STARTS, rate_scale=1.0, bounds=SPECIES_BOUNDS,
    min_r2=MIN_R2, min_points=MIN_POINTS, max_rounds=SPECIES_ROUNDS,
)
LOG_SINGLE_START = FitPlan(
    log_space=True, starts=(BREAK_START,), rate_scale=BREAK_SHARE, bounds=BREAK_BOUNDS, min_points=MIN_POINTS,
    max_rounds=BREAK_ROUNDS,
)


def _gathered(runs: DataFrame, keys: list[str], log_space: bool) -> DataFrame:
    """One row per key: its points by t (bounded by its time span), their number, mean interval and scatter within runs."""
    mean_log = curves.run_mean_log(F.col("k_lo"), F.col("k_hi"), F.col("n")) if log_space else F.lit(None)
    m = F.col("m").cast("double")
    point = F.struct(F.col("t").cast("double").alias("t"), m.alias("m"), F.col("mean_y").alias("y"), mean_log.cast("double").alias("log"))
    total = F.max("total")
    return runs.select(*keys, F.col("n").alias("total"), point.alias("point")).groupBy(*keys).agg(
        total.alias("n"),
        F.array_sort(F.collect_list("point")).alias("points"),
        (F.sum(F.col("point.m") * F.col("point.t")) / total).alias("mean_t"),
        (F.sum(F.col("point.m") * (F.col("point.m") * F.col("point.m") - 1.0)) / (12.0 * total * total)).alias("within"),
    )


def _starts(plan: FitPlan) -> Column:
    """The starts of a plan that lie within its bounds, as (start_no, start); none for a key with too few points."""
    rate = F.lit(1.0) if plan.rate_scale is None else 1.0 / F.nullif(plan.rate_scale * F.col("mean_t"), F.lit(0.0))
    each = []
    for number, (a1, r1, a2, r2) in enumerate(plan.starts, start=1):
        values = [F.lit(float(a1)), r1 * rate, F.lit(float(a2)), r2 * rate]
        inside = [c.between(float(low), float(high)) for c, low, high in zip(values, *plan.bounds)]
        if (a1, r1) == (a2, r2):
            values[1] = F.least(values[1] * (1.0 + SYMMETRY_BREAK), F.lit(float(plan.bounds[1][1])))
        possible = (F.col("n") >= plan.min_points) & inside[0] & inside[1] & inside[2] & inside[3]
        if plan.rate_scale is not None:
            possible = possible & (F.col("mean_t") > 0)
        each.append(F.struct(F.lit(number).cast("bigint").alias("start_no"), F.array(*values).alias("start"), possible.alias("possible")))
    return F.filter(F.array(*each), lambda s: s["possible"])


def _searches(plan: FitPlan, key_columns: int):
    """Solves the searches of a batch: keys, n, start_no, start, within, points -> keys, n, start_no, theta, status, r2."""
    floor = LOG_FLOOR if plan.log_space else None

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, start_no, start, within, listed = batch.columns[key_columns:]
        some = np.flatnonzero(start_no.is_valid().to_numpy(zero_copy_only=False))
        theta, status, r2 = np.full((len(n), 4), np.nan), np.full(len(n), HOPELESS), np.full(len(n), np.nan)
        if len(some):
            listed, given = listed.take(pa.array(some)), start.take(pa.array(some)).flatten().to_numpy().reshape(-1, 4)
            t, m, mean_y, log = (listed.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            points = Points(t, m, log if plan.log_space else mean_y, listed.value_lengths().to_numpy().astype(np.int64))
            total = n.to_numpy().astype(float)[some]
            scatter, spread = within.to_numpy()[some], (total * total - 1) / (12 * total)
            number = start_no.take(pa.array(some)).to_numpy()
            # Starts of one key lie together and in order.
            rows = [tuple(c[int(i)].as_py() for c in batch.columns[:key_columns]) for i in some]
            key = np.cumsum([i > 0 and rows[i] != rows[i - 1] for i in range(len(rows))])

            def scores(which: np.ndarray, at: np.ndarray) -> np.ndarray:
                own = np.zeros(len(some), bool)
                own[which] = True
                part = points.only(own)
                e1, e2, a1, a2 = part.curves(at)
                off = mean_y[own[points.owner]] - a1 * e1 - a2 * e2 - (floor or 0.0)
                return 1 - (scatter[which] + part.sums(part.m * off * off)) / spread[which]

            def accepted(which: np.ndarray, at: np.ndarray) -> np.ndarray:
                """Later starts of a key for which an earlier one is good enough."""
                good = which if plan.min_r2 is None else which[scores(which, at) > plan.min_r2]
                first = np.full(key[-1] + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, key[good], number[good])
                return np.flatnonzero(number > first[key])

            with np.errstate(all="ignore"):
                found, how = search(points, given, floor, plan.bounds, plan.max_rounds, accepted)
                theta[some], status[some], r2[some] = found, how, scores(np.arange(len(some)), found)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(n) + 1, 4), pa.int32()), pa.array(theta.reshape(-1)))
        columns = [*batch.columns[: key_columns + 2], parts, pa.array(status.astype(np.int32)), pa.array(r2)]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: key_columns + 2], "theta", "status", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # So many searches at once that their points stay a few million numbers.
            upto = np.cumsum(batch.columns[-1].value_lengths().fill_null(0).to_numpy()) // AT_ONCE
            edges = np.r_[0, np.flatnonzero(np.diff(upto)) + 1, batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if high > low:
                    yield solve(batch.slice(int(low), int(high - low)))

    return run


def _searched(gathered: DataFrame, plan: FitPlan, keys: list[str]) -> DataFrame:
    """Keys, n, start_no, theta, status and R2 of every start, a row each; a key without a start has one row of nulls."""
    tasks = int(gathered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number is stated, since by bytes AQE would put all searches into one task.
    dealt = gathered.repartition(tasks, *keys).withColumn("s", F.explode_outer(_starts(plan)))
    given = dealt.select(*keys, "n", "s.start_no", "s.start", "within", "points")
    out = given.select(*keys, "n", "start_no").schema
    out = out.add("theta", T.ArrayType(T.DoubleType())).add("status", "integer").add("r2", "double")
    return given.mapInArrow(_searches(plan, len(keys)), out)


def _chosen(searched: DataFrame, name: str, plan: FitPlan, keys: list[str]) -> DataFrame:
    """The first acceptable start of each key, or why there is none: what became of the last one."""
    good = F.col("status") == CONVERGED
    if plan.min_r2 is not None:
        good = good & (F.col("r2") > plan.min_r2)
    fault = F.when(F.col("status") == CONVERGED, "poor fit").when(F.col("status") == STALLED, "stalled").otherwise("not converged")
    best = searched.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min_by(F.when(good, F.col("theta")), F.when(good, F.col("start_no"))).alias("theta"),
        F.min(F.when(good, F.col("start_no"))).alias("start_no"),
        F.max_by(F.when(F.col("start_no").isNotNull(), fault), "start_no").alias("fault"),
    )
    reason = F.when(F.col("start_no").isNotNull(), None).when(F.col("n") < plan.min_points, "too few points")
    return best.select(
        F.lit(name).alias("fit"),
        F.lit(plan.log_space).alias("log_space"),
        *keys,
        "n",
        *[F.get("theta", F.lit(i)).alias(p) for i, p in enumerate(PARAMETERS)],
        "start_no",
        F.col("start_no").isNotNull().alias("converged"),
        reason.otherwise(F.coalesce("fault", F.lit("no feasible start"))).alias("reason"),
    )


def fit_all(runs: DataFrame, plans: dict[str, FitPlan], keys: Sequence[str] = ("site",)) -> DataFrame:
    """Fitted parameters per key and plan.

    ``(fit, log_space, keys, n, a1, l1, a2, l2, start_no, converged, reason)``, one
    row for every key and plan; parameters are null where nothing was accepted.
    """
    keys = list(keys)
    gathered = _gathered(runs, keys, any(p.log_space for p in plans.values()))
    return reduce(DataFrame.unionByName, [_chosen(_searched(gathered, plan, keys), name, plan, keys) for name, plan in plans.items()])


def fit(runs: DataFrame, plan: FitPlan, keys: Sequence[str] = ("site",)) -> DataFrame:
    """``fit_all`` of a single plan, without its name."""
    return fit_all(runs, {"fit": plan}, keys).drop("fit", "log_space")


def _curve(log_space: bool | Column) -> Column:
    """The fitted curve at ``t``; a fit in log space adds the floor under its logarithm."""
    return curves.survivor(F.col("t"), *[F.col(p) for p in PARAMETERS]) + _floor(log_space)


def _floor(log_space: bool | Column) -> Column:
    flag = log_space if isinstance(log_space, Column) else F.lit(log_space)
    return F.when(flag, F.lit(LOG_FLOOR)).otherwise(F.lit(0.0))


def with_quality(
    runs: DataFrame, params: DataFrame, keys: Sequence[str] = ("site",), log_space: bool | Column = False
) -> DataFrame:
    """``params`` with ``r2`` and ``mae`` of the curve in linear space, over every point of the runs.

    Both are null where there are no parameters. The fits are read once: their
    columns are grouped by along with the keys.
    """
    keys = list(keys)
    lo, hi, n = F.col("k_lo"), F.col("k_hi"), F.col("points")
    value = _curve(log_space)
    shape = runs.select(*keys, "t", "m", "k_lo", "k_hi", "mean_y", F.col("n").alias("points"))
    off = F.pow(F.col("mean_y") - value, F.lit(2.0))
    sums = params.join(shape, keys).groupBy(*params.columns).agg(
        F.max("points").cast("double").alias("points"),
        F.sum(curves.run_spread(lo, hi, n) + F.col("m") * off).alias("sse"),
        F.sum(curves.run_absolute_error(lo, hi, n, value)).alias("sae"),
    )
    spread = (F.col("points") * F.col("points") - 1.0) / (12.0 * F.col("points"))
    return sums.select(
        *params.columns,
        F.when(spread > 0, 1.0 - F.col("sse") / spread).alias("r2"),
        (F.col("sae") / F.col("points")).alias("mae"),
    )


def optimality(runs: DataFrame, params: DataFrame, plan: FitPlan, keys: Sequence[str] = ("site",)) -> DataFrame:
    """``(keys, gain, in_bounds)`` of fitted parameters, from the runs alone and not from the search.

    ``gain`` is the largest share of the squared error that moving one parameter could still take away, to
    first order. A parameter at a bound that the error pushes outwards cannot move.
    """
    keys = list(keys)
    lo, hi, n = F.col("k_lo"), F.col("k_hi"), F.col("points")
    a1, l1, a2, l2, t = (F.col(c) for c in (*PARAMETERS, "t"))
    e1, e2 = F.exp(-l1 * t), F.exp(-l2 * t)
    f = a1 * e1 + a2 * e2
    height = f + LOG_FLOOR if plan.log_space else F.lit(1.0)
    target = curves.run_mean_log(lo, hi, n) if plan.log_space else F.col("mean_y")
    off = target - (F.log(height) if plan.log_space else f)
    slopes = [d / height for d in (e1, -a1 * t * e1, e2, -a2 * t * e2)]
    shape = runs.select(*keys, "t", "m", "k_lo", "k_hi", "mean_y", F.col("n").alias("points"))
    given = params.select(*keys, *PARAMETERS).na.drop()
    sums = given.join(shape, keys).groupBy(*keys, *PARAMETERS).agg(
        F.sum(F.col("m") * off * off).alias("error"),
        *[F.sum(F.col("m") * off * d).alias(f"pull{i}") for i, d in enumerate(slopes)],
        *[F.sum(F.col("m") * d * d).alias(f"size{i}") for i, d in enumerate(slopes)],
    )
    gains, inside = [], F.lit(True)
    for i, (name, low, high) in enumerate(zip(PARAMETERS, *plan.bounds)):
        pull, at = F.col(f"pull{i}"), F.col(name)
        held = ((at <= low) & (pull < 0)) | ((at >= high) & (pull > 0))
        share = pull * pull / F.nullif(F.col(f"size{i}") * F.col("error"), F.lit(0.0))
        gains.append(F.when(held, 0.0).otherwise(F.coalesce(share, F.lit(0.0))))
        inside = inside & at.between(low, high)
    return sums.select(*keys, F.greatest(*gains).alias("gain"), inside.alias("in_bounds"))


def goodness_of_fit(
    runs: DataFrame, params: DataFrame, keys: Sequence[str] = ("site",), log_space: bool = False
) -> DataFrame:
    """``(keys, n, r2, mae)`` of given parameters."""
    sizes = runs.groupBy(*keys).agg(F.max("n").alias("n"))
    given = params.select(*keys, *PARAMETERS).na.drop().join(sizes, list(keys))
    return with_quality(runs, given, keys, log_space).select(*keys, "n", "r2", "mae")


def prediction_grid(
    runs: DataFrame, params: DataFrame, points: int = 200, keys: Sequence[str] = ("site",), log_space: bool = False
) -> DataFrame:
    """The fitted curve and its two components at ``points`` even steps from 0 to the longest interval."""
    ends = runs.groupBy(*keys).agg(F.max("t").alias("t_max"))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = (
        ends.join(params.select(*keys, *PARAMETERS).na.drop(), list(keys))
        .select(*keys, "t_max", *PARAMETERS, F.explode(steps).alias("step"))
        .withColumn("t", F.col("step") * F.col("t_max") / F.lit(float(points - 1)))
    )
    floor = _floor(log_space)
    return grid.select(
        *keys,
        "step",
        "t",
        _curve(log_space).alias("total"),
        (F.col("a1") * F.exp(-F.col("l1") * F.col("t")) + floor).alias("within_bout"),
        (F.col("a2") * F.exp(-F.col("l2") * F.col("t")) + floor).alias("between_bout"),
    )
