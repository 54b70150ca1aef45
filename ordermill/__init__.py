"""Spark jobs for the data of an online ordering system.

Every public function takes and returns DataFrames, takes column names and the
current time as arguments, and leaves physical planning to Spark.
"""
