"""Market basket: item co-occurrence, association rules, recommendations.

A product whose own support is below the rule threshold cannot be in a rule, so
the item counts come first and only frequent products go on, under numbers
instead of names.  Each order's basket is then one sorted list of numbers;
identical baskets are counted once, and pairs are counted over the distinct
baskets, weighted by their count, with map-side combining.  No order is joined
with another.

Scale: frequent items are at most (mean basket size) / ``min_support``, which
bounds the item table, the length of a basket list and the pair table.  The
pairs of a basket longer than ``LONG_BASKET`` are made by many tasks: one row
per item and its partners, dealt out before the partners are unfolded.  No
side is broadcast by force: adaptive execution measures the item table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import ratio, round_even
from tillroll.operators._common import non_null, reuse, running_totals, with_scalars
from tillroll.schema import empty, has

MIN_LIFT = 1.1     # fixed value: rules must have lift above this
LONG_BASKET = 128  # items; the pairs of longer baskets are dealt out
RULES_SCHEMA = ("product_a string, product_b string, support double, confidence double, "
                "lift double")


def top_basket_products(sales: DataFrame, max_products: int) -> DataFrame:
    """(product): the ``max_products`` most frequent products by line count
    (ties by name)."""
    lines = non_null(sales, "product").groupBy("product").agg(F.count(F.lit(1)).alias("lines"))
    return lines.orderBy(F.col("lines").desc(), F.col("product")).limit(max_products).select("product")


def basket_items(sales: DataFrame, max_products: int | None = None) -> DataFrame:
    """Long basket matrix: (order_id, product, in_basket); ``in_basket`` when the
    line revenue of the pair sums above 0.  ``max_products`` keeps the lines of
    the most frequent products only."""
    if not has(sales, "order_id", "product"):
        return empty(sales.sparkSession, "order_id string, product string, in_basket boolean")
    lines = non_null(sales, "order_id", "product")
    if max_products is not None:
        lines = lines.join(F.broadcast(top_basket_products(sales, max_products)), "product", "left_semi")
    rev = F.col("revenue") if has(sales, "revenue") else F.lit(1)
    return (lines.groupBy("order_id", "product").agg(F.sum(rev).alias("_rev"))
                 .select("order_id", "product", F.coalesce(F.col("_rev") > 0, F.lit(False)).alias("in_basket")))


def _counted(sales: DataFrame, min_support: float, max_products: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(product, orders, no) of the frequent items, numbered; (a, b, both) of
    their numbers; one row (n), the orders with at least one line of a product."""
    cells = reuse(basket_items(sales, max_products))
    total = cells.agg(F.count_distinct("order_id").alias("n"))
    held = cells.filter("in_basket").select("order_id", "product")
    items = with_scalars(held.groupBy("product").agg(F.count(F.lit(1)).alias("orders")), total)
    items = items.filter(ratio("orders", "n") >= F.lit(float(min_support))).select("product", "orders")
    if min_support > 0:      # at most (mean basket size) / min_support rows: one task numbers them
        items = items.withColumn("no", F.row_number().over(Window.orderBy("product")).cast("int"))
    else:
        items = running_totals(reuse(items), "orders", "product").select("product", "orders", F.col("rank").cast("int").alias("no"))
    items = reuse(items)
    baskets = (held.join(items.select("product", "no"), "product").groupBy("order_id")
               .agg(F.sort_array(F.collect_list("no")).alias("items"))
               .groupBy("items").agg(F.count(F.lit(1)).alias("cnt")))
    return items, numbered_pairs(reuse(baskets)), total


def _named(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of numbers -> (product_a, product_b, both, n_a, n_b), a before b by
    name, with the orders of either."""
    side = lambda c: items.select(F.col("no").alias(c), F.struct("product", "orders").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    first, second = F.least("_a", "_b"), F.greatest("_a", "_b")
    return both.select(first["product"].alias("product_a"), second["product"].alias("product_b"), "both",
                       first["orders"].alias("n_a"), second["orders"].alias("n_b"))


def cooccurrence(sales: DataFrame, min_support: float = 0.0,
                 max_products: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (items, pairs, total):

    items: (product, orders) - orders whose basket holds the product, for
    products in at least ``min_support`` of the orders;
    pairs: (product_a, product_b, both) for a before b by name;
    total: one row (n) - orders with at least one line of a product.
    """
    items, pairs, total = _counted(sales, min_support, max_products)
    return items.select("product", "orders"), _named(pairs, items).select("product_a", "product_b", "both"), total


def numbered_pairs(baskets: DataFrame) -> DataFrame:
    """(items, cnt) with ascending item numbers -> (a, b, both), a before b."""
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    first = lambda df: df.select("items", "cnt", F.posexplode("items").alias("at", "a")).select("a", rest.alias("rest"), "cnt", "at")
    size = F.size("items")
    short = first(baskets.where(size <= LONG_BASKET))
    long = first(baskets.where(size > LONG_BASKET)).repartition("a", "at", F.xxhash64("rest"))
    return (short.unionByName(long).select("a", F.explode("rest").alias("b"), "cnt")
            .groupBy("a", "b").agg(F.sum("cnt").alias("both")))


def product_associations(sales: DataFrame, min_support: float = 0.02, max_products: int | None = None,
                         top: int | None = None) -> DataFrame:
    """Pair rules a -> b (a before b by name): support, confidence of a -> b
    and lift; kept when support >= ``min_support`` and lift > 1.1.  ``top``
    keeps the best rules by (rounded) lift, ``max_products`` looks at the most
    frequent products only."""
    if not has(sales, "order_id", "product"):
        return empty(sales.sparkSession, RULES_SCHEMA)
    items, pairs, total = _counted(sales, min_support, max_products)
    # few pairs are frequent: the others go before any gets its names
    frequent = with_scalars(pairs, total).withColumn("_support", F.col("both") / F.col("n")) \
        .filter(F.col("_support") >= F.lit(float(min_support)))
    r = with_scalars(_named(frequent.select("a", "b", "both"), items), total).withColumn("_support", F.col("both") / F.col("n"))
    conf = F.col("_support") / (F.col("n_a") / F.col("n"))
    lift = F.col("_confidence") / (F.col("n_b") / F.col("n"))
    rules = (r.withColumn("_confidence", conf).withColumn("_lift", lift)
              .filter(F.col("_lift") > F.lit(MIN_LIFT)))
    out = rules.select("product_a", "product_b",
                       round_even("_support", 4).alias("support"),
                       round_even("_confidence", 4).alias("confidence"),
                       round_even("_lift", 3).alias("lift"))
    out = out.orderBy(F.col("lift").desc(), "product_a", "product_b")
    return out if top is None else out.limit(top)


def recommendations(rules: DataFrame, n: int = 5) -> DataFrame:
    """For every product in any rule: up to ``n`` partners by lift (the
    partner from either side; confidence kept as stored on the rule)."""
    both = (rules.select(F.col("product_a").alias("product"),
                         F.col("product_b").alias("recommended"), "lift", "confidence")
            .unionByName(rules.select(F.col("product_b").alias("product"),
                                      F.col("product_a").alias("recommended"), "lift",
                                      "confidence")))
    w = Window.partitionBy("product").orderBy(F.col("lift").desc(), F.col("recommended"))
    return (both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                .orderBy("product", "rank"))


def recommend_for_product(rules: DataFrame, product: str, n: int = 5) -> DataFrame:
    return recommendations(rules, n).filter(F.col("product") == product)


def rule_products(rules: DataFrame) -> DataFrame:
    return (rules.select(F.col("product_a").alias("product"))
                 .union(rules.select(F.col("product_b").alias("product")))
                 .distinct().orderBy("product"))
