"""Seasonal harvest and packing analytics as Spark DataFrame jobs.

``plans``      named datasets built from the source tables, and the season report
``operators``  analytical operators over those datasets
``functions``  column and aggregate expressions with fixed missing-value rules
``sources``    table, JDBC, CSV and SQL-file readers, and report sinks
"""
