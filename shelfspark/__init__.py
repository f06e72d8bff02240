"""Spark-native analytics over knowledge archives.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame ->
DataFrame), ``sources`` (readers and writers), ``plans`` (user-level reports
composed from operators), ``streaming`` (Structured Streaming twins) and
``verify`` (the queries and SQL oracles the driver compares).
"""
