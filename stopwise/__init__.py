"""Delivery routing and customer-territory analytics as Spark DataFrame jobs."""
