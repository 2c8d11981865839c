"""tablelens: explore, clean and explain tables of any size on Spark.

Every public operator takes a DataFrame (plus plain parameters) and returns a
DataFrame.  Heavy work is expressed with built-in Spark SQL functions so that
Catalyst can prune columns, push filters into the scan and share scans; Python
only runs inside Arrow-batched functions where no built-in exists.
"""

__version__ = "0.1.0"
