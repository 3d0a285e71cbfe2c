"""Retail analytics and corpus preparation as plain PySpark DataFrame transformations."""
