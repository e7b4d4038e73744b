"""Registered queries: every operator bound to the driver's parquet tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import (basket, churn, clean, cohort, columns, currency, customers, forecast,
                                insights, kpi, ltv, performance, products, profiles, rollups, segments,
                                timeseries)
from tillroll.functions import sig_round
from tillroll.operators._common import intermediates, release
from tillroll.session import apply_defaults
from tillroll.sources import derived, fixtures
from tillroll.sources.tables import write_table

Query = Callable[[SparkSession, str], DataFrame]


def _on_sales(op, **kw) -> Query:
    return lambda spark, sf_dir: op(fixtures.sales(spark, sf_dir), **kw)


def _on_purchases(op, **kw) -> Query:
    return lambda spark, sf_dir: op(fixtures.purchases(spark, sf_dir), **kw)


# Floating aggregates (averages / sums of doubles) whose last bits depend on
# the combine order of partitions; reported to 12 significant digits.
STABLE: dict[str, list[str]] = {
    "seasonality_stats": ["avg_mom_growth", "cv"],
    "rfm_averages": ["avg_monetary"],
    "retention_curve": ["retention_pct"],
    "cohort_summary": ["m1_retention", "m3_retention", "m6_retention"],
    "ltv_overview": ["avg_ltv", "total_predicted", "avg_untapped"],
    "ltv_segment_breakdown": ["total_ltv"],
    "ltv_segment_table": ["avg_historical_ltv", "avg_predicted_ltv", "avg_total_ltv", "avg_orders",
                          "avg_aov", "avg_recency"],
    "ltv_insights": ["platinum_pct", "platinum_ltv_pct", "avg_ltv", "avg_aov", "predicted_total"],
    "performance_class_revenue": ["total_revenue"],
    "forecast_summary": ["total_predicted", "avg_predicted"],
    "forecast_insights": ["recent_avg", "forecast_avg", "change_pct", "total_projected"],
    "sales_observations": ["value"],
    "fixed_cluster_summary": ["total_revenue"],
}

MIN_SUPPORT = 0.005   # the page's default support threshold


# Sums over many parsed doubles: fewer significant digits are reproducible.
DIGITS: dict[str, int] = {}


def _stable(q: Query, cols: list[str], digits: int) -> Query:
    return lambda spark, sf_dir: q(spark, sf_dir).withColumns(
        {c: sig_round(c, digits) for c in cols})


def _clean_amounts(spark: SparkSession, sf_dir: str, parity: bool) -> DataFrame:
    texts = derived.amount_texts(spark, sf_dir)
    return clean.clean_revenue(texts.withColumn("revenue", texts.amount_text), parity=parity)


def _cleaned(mapped: DataFrame) -> DataFrame:
    """``clean_sales``, but rows are parsed once: the typed rows are written, and
    read for the unit-price test and for the result."""
    return clean.fix_unit_price(write_table(clean.typed_sales(mapped), "typed"))


def _sales_from_text_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillroll.plans.ingest import standardize

    # read for the date order and for the rows
    mapped, _ = standardize(write_table(derived.sales_as_text(spark, sf_dir), "text"), file_id="sales_text")
    # the text carries 4 decimals: hold the parsed amounts exactly before summing
    cleaned = _cleaned(mapped).withColumn("revenue", F.col("revenue").cast("decimal(18,4)"))
    return timeseries.monthly_revenue(cleaned)


def _days(texts: Query) -> Query:
    """Rows per calendar day after date cleaning."""
    return lambda spark, sf_dir: (clean.clean_date(texts(spark, sf_dir))
                                  .groupBy(F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("rows")))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = derived.sales_as_text(spark, sf_dir)
    names = ["Order Date", "Qty", "Sub-Category", "Country"]
    # a dotted header and a column without any value are ordinary input
    odd = text.withColumnRenamed("Country", "Ship.Country").withColumn("Empty", F.lit(None).cast("string"))
    out = columns.profile_columns(odd, [*names[:3], "Ship.Country", "Empty"])
    return out.select("column_name", "non_null", "date_rate", "numeric_rate", sig_round("mean").alias("mean"),
                      "all_integer")


def _mapping_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that say nothing: only the contents can name the columns."""
    from tillroll.plans.ingest import standardize

    unknown = {"date": "zz1", "revenue": "zz2", "quantity": "zz3", "product": "zz4", "category": "zz5"}
    raw = derived.sales_under(spark, sf_dir, unknown).select(*unknown.values())
    plain = raw.withColumn("zz2", F.regexp_replace("zz2", "[$]", ""))
    _, report = standardize(plain, file_id="unknown")
    return report.select("column_name", "standard", "method")


def _fuzzy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillroll.plans.ingest import standardize

    text = write_table(derived.sales_under(spark, sf_dir, derived.FUZZY_HEADERS), "text")
    mapped, _ = standardize(text, file_id="fuzzy", sniff=False)
    return products.revenue_by_category(_cleaned(mapped).withColumn(
        "revenue", F.col("revenue").cast("decimal(18,4)")))


def _supplier_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    texts = derived.amount_texts(spark, sf_dir).join(li, ["l_orderkey", "l_linenumber"])
    return currency.currency_from_texts(texts, "l_suppkey", F.col("amount_text"))


def _files_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files with headers of their own: the same lines, the same months."""
    from tillroll.plans.files import load_cells

    cells, catalog = derived.sales_files(spark, sf_dir)
    loaded = load_cells(write_table(cells, "cells"), catalog).sales
    return timeseries.monthly_revenue(loaded.withColumn("revenue", F.col("revenue").cast("decimal(18,4)")))


def _files_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = profiles.cell_values(write_table(derived.sales_files(spark, sf_dir)[0], "cells"))
    sketches = write_table(profiles.profile_sketches(values), "sketches")
    found = profiles.exact_distinct(values, profiles.column_profiles(sketches))
    return found.select("file_id", "position", "non_null", "date_rate", "numeric_rate", sig_round("mean").alias("mean"),
                        "all_integer", (F.col("distinct") <= columns.CATEGORY_LIMIT).alias("few_values"))


def _files_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillroll.plans.files import load_cells

    cells, catalog = derived.nation_files(spark, sf_dir)
    return load_cells(write_table(cells, "cells"), catalog).currencies()


def _files_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.file_availability(columns.match_headers(derived.customer_headers(spark, sf_dir)))
    return found.withColumn("missing", F.array_join("missing", ","))


def _canonical(op, months: tuple[str, str] | None = None) -> Query:
    """An operator over the canonical table that a query writes for itself."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tillroll.plans.canonical import read_canonical, write_canonical

        return op(read_canonical(spark, write_canonical(fixtures.sales(spark, sf_dir)), months))
    return run


def _fixed_clusters(sales: DataFrame) -> DataFrame:
    assigned = customers.rfm(sales).withColumn("cluster", (F.col("customer_id") % 5).cast("int"))
    return segments.segment_summary(segments.label_clusters(assigned, 5))


def registry() -> dict[str, Query]:
    """The queries.  What one of them persists is released when the same
    registry starts its next query."""
    last: list[DataFrame] = []

    def with_defaults(q: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            release(last)
            with intermediates() as frames:
                out = q(spark, sf_dir)
            last.extend(frames)
            return out
        return run

    q = {k: with_defaults(v) for k, v in _registry().items()}
    return {k: (_stable(v, STABLE[k], DIGITS.get(k, 12)) if k in STABLE else v)
            for k, v in q.items()}


def _registry() -> dict[str, Query]:
    q: dict[str, Query] = {
        # time series / KPIs
        "monthly_growth": _on_sales(timeseries.monthly_growth),
        "kpi_summary": _on_sales(kpi.kpi_summary),
        "kpi_summary_purchases": _on_purchases(kpi.kpi_summary),
        "daily_revenue": _on_sales(timeseries.daily_revenue),
        "weekly_revenue": _on_sales(timeseries.weekly_revenue),
        "monthly_revenue": _on_sales(timeseries.monthly_revenue),
        "daily_revenue_purchases": _on_purchases(timeseries.daily_revenue),
        "weekly_revenue_purchases": _on_purchases(timeseries.weekly_revenue),
        "time_series_daily": _on_sales(timeseries.time_series, freq="D"),
        "time_series_weekly": _on_sales(timeseries.time_series, freq="W"),
        "time_series_weekly_purchases": _on_purchases(timeseries.time_series, freq="W"),
        "new_customers_by_month": _on_sales(kpi.new_customers_by_month),
        "seasonality_stats": _on_sales(timeseries.seasonality_stats),
        # products / categories / regions
        "top_products": _on_sales(products.top_products, n=10),
        "revenue_by_category": _on_sales(products.revenue_by_category),
        "revenue_by_region": _on_sales(products.revenue_by_region),
        "weakest_category": _on_sales(products.weakest_category),
        "product_pareto": _on_sales(products.product_pareto),
        "product_concentration": _on_sales(products.product_concentration),
        "customer_concentration": _on_sales(products.customer_concentration),
        # customers: RFM, churn features and rule scores
        "rfm": _on_sales(customers.rfm),
        "rfm_averages": _on_sales(customers.rfm_averages),
        "rfm_purchases": _on_purchases(customers.rfm),
        "customer_features": _on_sales(customers.customer_features),
        "customer_features_purchases": _on_purchases(customers.customer_features),
        "churn_rule": _on_sales(churn.churn_rule),
        "risk_distribution": _on_sales(lambda s: churn.risk_distribution(churn.churn_rule(s))),
        "top_high_risk": _on_sales(lambda s: churn.top_high_risk(churn.churn_rule(s))),
        "churn_histogram": _on_sales(lambda s: churn.churn_histogram(churn.churn_rule(s))),
        "churn_insights": _on_sales(lambda s: churn.churn_insights(churn.churn_rule(s))),
        # cohorts
        "cohort_counts": _on_sales(cohort.cohort_counts),
        "cohort_retention": _on_sales(cohort.cohort_retention),
        "cohort_display": _on_sales(cohort.cohort_display, cohorts=18, periods=18),
        "retention_curve": _on_sales(cohort.retention_curve),
        "cohort_sizes": _on_sales(cohort.cohort_sizes),
        "cohort_summary": _on_sales(cohort.cohort_summary),
        "retention_matrix": _on_sales(cohort.retention_matrix),
        # lifetime value
        "customer_ltv": _on_sales(ltv.customer_ltv),
        "ltv_overview": _on_sales(lambda s: ltv.ltv_overview(ltv.customer_ltv(s))),
        "ltv_histogram": _on_sales(lambda s: ltv.ltv_histogram(ltv.customer_ltv(s))),
        "ltv_segment_breakdown": _on_sales(lambda s: ltv.ltv_segment_breakdown(ltv.customer_ltv(s))),
        "ltv_segment_table": _on_sales(lambda s: ltv.ltv_segment_table(ltv.customer_ltv(s))),
        "top_ltv_customers": _on_sales(lambda s: ltv.top_ltv_customers(ltv.customer_ltv(s))),
        "ltv_insights": _on_sales(lambda s: ltv.ltv_insights(ltv.customer_ltv(s))),
        # market basket
        "basket_items": _on_sales(basket.basket_items),
        "product_associations": _on_sales(basket.product_associations, min_support=MIN_SUPPORT),
        "product_associations_low_support": _on_sales(basket.product_associations,
                                                      min_support=0.001),
        "product_recommendations": _on_sales(lambda s: basket.recommendations(
            basket.product_associations(s, min_support=MIN_SUPPORT))),
        "rule_products": _on_sales(lambda s: basket.rule_products(
            basket.product_associations(s, min_support=MIN_SUPPORT))),
        # product performance
        "product_performance": _on_sales(performance.product_performance),
        "performance_class_revenue": _on_sales(lambda s: performance.performance_class_revenue(
            performance.product_performance(s))),
        "top_products_by_score": _on_sales(lambda s: performance.top_products_by_score(
            performance.product_performance(s), None, 20)),
        "top_average_products": _on_sales(lambda s: performance.top_products_by_score(
            performance.product_performance(s), "Average", 50)),
        # forecasting
        "forecast_revenue": _on_sales(forecast.forecast_revenue),
        "forecast_revenue_parity": _on_sales(forecast.forecast_revenue, parity=True),
        "forecast_fit_quality": _on_sales(forecast.forecast_fit_quality),
        "forecast_by_category": _on_sales(forecast.forecast_by_category),
        "forecast_fit_by_category": _on_sales(forecast.forecast_fit_quality, key="category",
                                              min_lines=forecast.MIN_DAYS),
        "moving_average_forecast": _on_sales(forecast.moving_average_forecast),
        "moving_average_forecast_purchases": _on_purchases(forecast.moving_average_forecast),
        "forecast_summary": _on_sales(lambda s: forecast.forecast_summary(
            forecast.forecast_revenue(s))),
        "forecast_insights": _on_sales(forecast.forecast_insights),
        # insight rules
        "kpi_insights": _on_sales(insights.kpi_insights),
        "health_score": _on_sales(insights.health_score),
        "risk_alerts": _on_sales(insights.risk_alerts),
        "recommendations": _on_sales(insights.recommendations),
        "sales_observations": _on_sales(insights.sales_observations),
        # ingest rules over text derived from the tables
        "clean_amount_strings": lambda spark, d: _clean_amounts(spark, d, parity=False),
        "clean_amount_strings_parity": lambda spark, d: _clean_amounts(spark, d, parity=True),
        "region_currency": _on_sales(currency.currency_from_region),
        "sales_from_text_monthly": _sales_from_text_monthly,
        # intraday purchase events: day floors, no product/category/region/quantity
        "customer_ltv_purchases": _on_purchases(ltv.customer_ltv),
        "cohort_retention_purchases": _on_purchases(cohort.cohort_retention),
        "churn_rule_purchases": _on_purchases(churn.churn_rule),
        "forecast_revenue_purchases": _on_purchases(forecast.forecast_revenue),
        "forecast_fit_quality_purchases": _on_purchases(forecast.forecast_fit_quality),
        # ingest rules over renderings of the tables
        "clean_dates_by_day": _days(derived.order_date_texts),
        "clean_dates_day_first": _days(lambda s, d: derived.order_date_texts(s, d, ["d/M/yyyy", "d.M.yyyy"])),
        "clean_event_timestamps": _days(lambda s, d: fixtures.table(s, d, "events").select(F.col("ts").alias("date"))),
        "date_report": lambda s, d: clean.date_report(derived.order_date_texts(s, d, ["M/d/yyyy", "'on' d MMM"])),
        "clean_quantities": lambda s, d: clean.clean_quantity(derived.quantity_texts(s, d)),
        "unit_price_fixed": lambda s, d: clean.fix_unit_price(derived.flat_price_lines(s, d))
                                              .groupBy("order_id").agg(F.sum("revenue").cast("decimal(38,2)").alias("revenue")),
        "derived_revenue": lambda s, d: clean.derive_revenue(derived.priced_lines(s, d))
                                             .select("l_orderkey", "l_linenumber", "revenue"),
        "sales_columns_profile": _profile,
        "mapping_unknown_headers": _mapping_unknown,
        "fuzzy_headers_by_category": _fuzzy_by_category,
        "dataset_overview": _on_sales(columns.dataset_overview),
        "supplier_currency": _supplier_currency,
        "country_currency": lambda s, d: currency.currency_from_region(derived.sales_by_country(s, d)),
        "revenue_series_weekly": _on_sales(timeseries.revenue_series, granularity="weekly"),
        "time_series_monthly": _on_sales(timeseries.time_series, freq="M"),
        "customer_ltv_no_date": _on_sales(lambda s: ltv.customer_ltv(s.drop("date"))),
        "fixed_cluster_summary": _on_sales(_fixed_clusters),
        "fixed_cluster_insights": _on_sales(lambda s: segments.segment_insights(_fixed_clusters(s))),
        "churn_split_sizes": _on_sales(churn.churn_split_sizes),
        "churn_metrics": _on_sales(churn.churn_metrics),
        "canonical_rfm": _canonical(customers.rfm),
        "canonical_year_by_category": _canonical(products.revenue_by_category, ("1997-01-01", "1997-12-01")),
        "lloyd_clusters": _on_sales(segments.lloyd_segments, rounds=3, label=False),
        "churn_feature_auc": _on_sales(churn.feature_auc),
        "approximate_months": _on_sales(rollups.approximate_months),
        # many files with headers of their own
        "files_monthly_revenue": _files_monthly,
        "files_header_mapping": lambda s, d: columns.match_headers(derived.customer_headers(s, d)).select(
            "file_id", "column_name", "standard", "method"),
        "files_column_profiles": _files_profile,
        "files_currency": _files_currency,
        "files_availability": _files_availability,
        # models (no SQL oracle: row checks and invariants in tests)
        "kmeans_segments": _on_sales(segments.kmeans_segments),
        "segment_summary": _on_sales(lambda s: segments.segment_summary(
            segments.kmeans_segments(s))),
        "churn_model_scores": _on_sales(churn.churn_model_scores),
    }
    return q
