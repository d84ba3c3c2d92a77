"""Demand planning on Spark: ledger cleaning, weekly series, features, models, plans and costs.

Every operator is a ``DataFrame -> DataFrame`` function that works for any number of SKUs.
"""
