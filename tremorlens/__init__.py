"""Disaster-reporting gap analytics on PySpark.

Every operator is a plain function from DataFrames (or Columns) to DataFrames
(or Columns).  Nothing here collects data to the driver: thresholds and small
dictionaries are parameters, anything that grows stays distributed.
"""

__version__ = "0.1.0"
