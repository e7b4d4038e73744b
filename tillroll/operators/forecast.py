"""Revenue forecasts: quadratic trend by closed-form least squares, and a
moving-average projection.

The quadratic fit never leaves Spark: per group (overall, or per category)
the fitted series is reduced to power sums of the centred, scaled day number
u and of u*y, the 3x3 normal equations are solved by Cramer's rule in column
expressions, and forecast dates are generated with ``sequence``.  Every step
is an aggregate or a join on the group key, so all categories are fitted in
one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import day, round_even, week_end_label
from tillroll.operators._common import non_null, reuse
from tillroll.schema import empty, has

# Fixed values of the forecasting rules.
MIN_DAYS = 14          # fewer positive days: no forecast
MIN_WEEKS = 8          # from this many positive weeks on, fit the weekly series
BAND = 1.5             # bounds = prediction +- 1.5 * residual std (population)
FIT_LABELS = [(0.8, "Excellent"), (0.5, "Good")]
FIT_DEFAULT = "Moderate"
RELIABILITY = [(0.7, "good"), (0.4, "moderate")]
RELIABILITY_DEFAULT = "low"

FORECAST_SCHEMA = "date date, predicted double, upper_bound double, lower_bound double"


def _keys(key: str | None) -> list[str]:
    return [key] if key else ["_g"]


def _base(sales: DataFrame, key: str | None) -> DataFrame:
    b = sales.filter(F.col("date").isNotNull())
    if key:
        return non_null(b, key)
    return b.withColumn("_g", F.lit(0))


def day_groups(sales: DataFrame, key: str | None = None) -> DataFrame:
    """The one pass over the raw lines: revenue and line count per (group,
    calendar day).  Every series, count and fit below derives from it."""
    keys = _keys(key)
    base = _base(sales, key)
    return reuse(base.groupBy(*keys, day("date").alias("date"))
                     .agg(F.sum("revenue").alias("_rev"), F.count(F.lit(1)).alias("_lines")))


def _positive(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.filter(F.col("_rev") > 0)
              .select(*keys, "date", F.col("_rev").cast("double").alias("y")))


def quadratic_fit(sales: DataFrame, key: str | None = None, min_lines: int = 0,
                  days: DataFrame | None = None) -> DataFrame:
    """Per group: the fitted series choice and coefficients.

    Columns: keys, weekly (bool), n, d_min, d_max (daily series span),
    x0 (first label of the fitted series, days since epoch), mu, sc (centre and
    scale of the day number), a, b, c (y = a + b*u + c*u^2), r2, resid_std.
    Groups with fewer than ``MIN_DAYS`` positive days (or fewer than
    ``min_lines`` lines) are absent.

    The daily and the weekly series are fitted side by side in the same
    passes (keyed by group and ``weekly``); the choice between them - weekly
    from ``MIN_WEEKS`` positive weeks on - is applied at the end."""
    keys = _keys(key)
    gk = keys + ["weekly"]
    dg = day_groups(sales, key) if days is None else days
    daily = _positive(dg, keys).withColumn("weekly", F.lit(False))
    weekly = _positive(dg.groupBy(*keys, week_end_label("date").alias("date"))
                         .agg(F.sum("_rev").alias("_rev")), keys).withColumn("weekly", F.lit(True))
    pts = reuse(daily.unionByName(weekly)
                     .select(*gk, "date", F.unix_date("date").alias("x"), "y"))
    # pass 1: size, span, centre and scale of the day number, mean of y
    s1 = pts.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.avg("x").alias("mu"),
        ((F.max("x") - F.min("x")) / F.lit(2.0)).alias("sc"), F.avg("y").alias("ybar"),
        F.min("date").alias("d_min"), F.max("date").alias("d_max"))
    wk = F.col("weekly")
    choice = s1.groupBy(*keys).agg(
        F.max(F.when(~wk, F.col("n"))).alias("n_days"), F.max(F.when(wk, F.col("n"))).alias("n_weeks"),
        F.max(F.when(~wk, F.col("d_min"))).alias("d_min"),
        F.max(F.when(~wk, F.col("d_max"))).alias("d_max"))
    choice = (choice.filter(F.col("n_days") >= MIN_DAYS)
                    .select(*keys, "d_min", "d_max",
                            (F.coalesce(F.col("n_weeks"), F.lit(0)) >= MIN_WEEKS).alias("weekly")))
    if min_lines:
        lines = dg.groupBy(*keys).agg(F.sum("_lines").alias("_lines"))
        choice = choice.join(lines, keys).filter(F.col("_lines") >= min_lines).drop("_lines")
    p = reuse(pts.join(s1.select(*gk, "mu", "sc", "ybar"), gk)
                 .withColumn("u", F.try_divide(F.col("x") - F.col("mu"), F.col("sc"))))
    u, y = F.col("u"), F.col("y")
    # pass 2: power sums -> normal equations
    s2 = p.groupBy(*gk).agg(
        F.sum(u).alias("S1"), F.sum(u * u).alias("S2"), F.sum(u * u * u).alias("S3"),
        F.sum(u * u * u * u).alias("S4"), F.sum(y).alias("T0"), F.sum(u * y).alias("T1"),
        F.sum(u * u * y).alias("T2"), F.sum((y - F.col("ybar")) * (y - F.col("ybar"))).alias("SST"))
    S0 = F.col("n").cast("double")
    S1, S2, S3, S4 = (F.col(c) for c in ("S1", "S2", "S3", "S4"))
    T0, T1, T2 = (F.col(c) for c in ("T0", "T1", "T2"))
    det = S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2)
    da = T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2)
    db = S0 * (T1 * S4 - S3 * T2) - T0 * (S1 * S4 - S3 * S2) + S2 * (S1 * T2 - T1 * S2)
    dc = S0 * (S2 * T2 - T1 * S3) - S1 * (S1 * T2 - T1 * S2) + T0 * (S1 * S3 - S2 * S2)
    # a series too short for a quadratic (the one not chosen) gets NULL coefficients
    coef = s1.join(s2, gk).select(*gk, "n", "x0", "mu", "sc", "SST",
                                  F.try_divide(da, det).alias("a"), F.try_divide(db, det).alias("b"),
                                  F.try_divide(dc, det).alias("c"))
    # pass 3: residuals
    fitted = p.join(coef.select(*gk, "a", "b", "c"), gk)
    resid = y - (F.col("a") + F.col("b") * u + F.col("c") * u * u)
    s3 = fitted.groupBy(*gk).agg(F.sum(resid * resid).alias("SSE"),
                                 F.stddev_pop(resid).alias("resid_std"))
    out = (choice.join(coef, gk).join(s3, gk)
                 .withColumn("r2", F.when(F.col("SST") == 0, F.when(F.col("SSE") == 0, 1.0)
                                                               .otherwise(0.0))
                                    .otherwise(F.lit(1.0) - F.col("SSE") / F.col("SST"))))
    return out.select(*keys, "weekly", "d_min", "d_max", "n", "x0", "mu", "sc", "a", "b", "c",
                      "resid_std", "r2")


def _predict(x_days: Column) -> Column:
    u = (x_days - F.col("mu")) / F.col("sc")
    return F.col("a") + F.col("b") * u + F.col("c") * u * u


def forecast_revenue(sales: DataFrame, days: int = 30, key: str | None = None,
                     parity: bool = False, min_lines: int = 0,
                     day_table: DataFrame | None = None) -> DataFrame:
    """Daily forecast for the ``days`` days after the last sale.

    Default: the fitted model is evaluated at the forecast date's own day
    number, and a weekly model's weekly totals are divided by 7 (predictions
    and bounds).  ``parity=True`` evaluates the model at "last daily day
    number + i" measured from the first *daily* date and does not rescale,
    which is how the original computes it."""
    if not has(sales, "date", "revenue") or (key and not has(sales, key)):
        return empty(sales.sparkSession, (f"{key} string, " if key else "") + FORECAST_SCHEMA)
    fit = quadratic_fit(sales, key, min_lines=min_lines, days=day_table)
    steps = fit.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(days))))
    date = F.date_add("d_max", F.col("i"))
    if parity:
        # "last daily day number + i", counted from the first daily date but
        # read in the model's frame, whose origin is the first fitted label x0
        x = F.datediff("d_max", "d_min") + F.col("i") + F.col("x0")
        scale = F.lit(1.0)
    else:
        x = F.unix_date(date)
        scale = F.when(F.col("weekly"), F.lit(7.0)).otherwise(F.lit(1.0))
    raw = F.greatest(_predict(x.cast("double")) / scale, F.lit(0.0))
    std = F.col("resid_std") / scale
    out = steps.select(*([key] if key else []), date.alias("date"), raw.alias("_p"),
                       std.alias("_s"))
    return out.select(*([key] if key else []), "date",
                      round_even("_p", 2).alias("predicted"),
                      round_even(F.col("_p") + F.lit(BAND) * F.col("_s"), 2).alias("upper_bound"),
                      round_even(F.greatest(F.col("_p") - F.lit(BAND) * F.col("_s"), F.lit(0.0)), 2)
                      .alias("lower_bound"))


def forecast_fit_quality(sales: DataFrame, key: str | None = None, min_lines: int = 0) -> DataFrame:
    """R^2 of the fitted series (rounded to 3) and its labels."""
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "model_score double, fit_label string")
    fit = quadratic_fit(sales, key, min_lines=min_lines)
    r2 = F.col("r2")
    label = F.when(r2 > FIT_LABELS[0][0], FIT_LABELS[0][1]).when(
        r2 > FIT_LABELS[1][0], FIT_LABELS[1][1]).otherwise(FIT_DEFAULT)
    rel = F.when(r2 >= RELIABILITY[0][0], RELIABILITY[0][1]).when(
        r2 >= RELIABILITY[1][0], RELIABILITY[1][1]).otherwise(RELIABILITY_DEFAULT)
    return fit.select(*([key] if key else []), round_even(r2, 3).alias("model_score"),
                      label.alias("fit_label"), rel.alias("reliability"),
                      F.when(F.col("weekly"), "W").otherwise("D").alias("fit_freq"),
                      F.col("n").cast("bigint").alias("fit_points"))


def forecast_by_category(sales: DataFrame, days: int = 30, parity: bool = False) -> DataFrame:
    """F1 for every category with at least 14 lines (and 14 positive days)."""
    return forecast_revenue(sales, days, key="category", parity=parity, min_lines=MIN_DAYS)


def _recent_daily(sales: DataFrame, day_table: DataFrame | None = None) -> DataFrame:
    """Positive daily series with its position from the end (rn, 1 = last)
    and from the start (rn_asc).  Windows run over the aggregated days."""
    dg = day_groups(sales) if day_table is None else day_table
    d = dg.filter(F.col("_rev") > 0).select("date", "_rev")
    return (d.withColumn("rn", F.row_number().over(Window.orderBy(F.col("date").desc())))
             .withColumn("rn_asc", F.row_number().over(Window.orderBy("date"))))


def moving_average_forecast(sales: DataFrame, window: int = 7, days: int = 30) -> DataFrame:
    """Mean of the last ``window`` positive days, projected with the daily
    growth against the ``window`` days before them (with fewer than
    2*``window`` days those are the first ``window`` days; empty below
    ``window`` days)."""
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "date date, predicted_revenue double")
    d = _recent_daily(sales)
    rn, rn_asc, rev = F.col("rn"), F.col("rn_asc"), F.col("_rev")
    st = d.agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last"),
        (F.sum(F.when(rn <= window, rev)).cast("double") / window).alias("recent"),
        (F.sum(F.when(rn.between(window + 1, 2 * window), rev)).cast("double") / window)
        .alias("_older_full"),
        (F.sum(F.when(rn_asc <= window, rev)).cast("double") / window).alias("_older_head"))
    st = (st.filter(F.col("n") >= window)
            .withColumn("older", F.when(F.col("n") >= 2 * window, F.col("_older_full"))
                                  .otherwise(F.col("_older_head"))))
    g = F.when(F.col("older") > 0, (F.col("recent") - F.col("older")) /
               (F.lit(float(window)) * F.col("older"))).otherwise(F.lit(0.0))
    steps = st.withColumn("g", g).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(days))))
    return steps.select(
        F.date_add("last", F.col("i")).alias("date"),
        F.greatest(F.col("recent") * (F.lit(1.0) + F.col("g") * F.col("i")), F.lit(0.0))
        .alias("predicted_revenue"))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.sum("predicted").alias("total_predicted"),
                        F.avg("predicted").alias("avg_predicted"),
                        F.max("predicted").alias("max_predicted"))


def forecast_insights(sales: DataFrame, days: int = 30, parity: bool = False) -> DataFrame:
    """Forecast mean vs the mean of the last 7 positive days: direction
    (grow > 1.1x, decline < 0.9x, else stable), change in %, total projected."""
    dg = day_groups(sales)
    f = forecast_revenue(sales, days, parity=parity, day_table=dg)
    fs = f.agg(F.avg("predicted").alias("forecast_avg"), F.sum("predicted").alias("total_projected"),
               F.count(F.lit(1)).alias("_n"))
    d = _recent_daily(sales, dg)
    recent = d.agg((F.sum(F.when(F.col("rn") <= 7, F.col("_rev"))).cast("double")
                    / F.least(F.count(F.lit(1)), F.lit(7))).alias("recent_avg"))
    s = fs.join(F.broadcast(recent), how="inner").filter(F.col("_n") > 0)
    fa, ra = F.col("forecast_avg"), F.col("recent_avg")
    direction = F.when(fa > ra * 1.1, "grow").when(fa < ra * 0.9, "decline").otherwise("stable")
    change = F.when(fa > ra * 1.1, (fa - ra) / ra * 100).when(fa < ra * 0.9, (ra - fa) / ra * 100)
    return s.select("recent_avg", "forecast_avg", direction.alias("direction"),
                    change.alias("change_pct"), "total_projected")
