"""revcurve: sales profiling, cleaning and subscription analytics as Spark DataFrame jobs.

Subpackages
-----------
functions   fixed vocabulary of the sales data and integer money arithmetic
sources     readers for the raw sales table (files, or the TPC-H-style test tables) and model sinks
operators   profiling, staging, mart and dashboard operators (DataFrame -> DataFrame)
plans       session set-up, model composition, query registry and the SQL oracle
"""

__version__ = "0.1.0"
