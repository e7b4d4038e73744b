"""tillroll: sales-line analytics as lazy Spark DataFrame operators.

Every operator takes a canonical ``sales`` DataFrame (columns ``date,
revenue, quantity, customer_id, product, category, region, order_id``, all
optional) and returns a lazy DataFrame with a fixed schema.
"""

__version__ = "0.1.0"
