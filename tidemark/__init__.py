"""tidemark: risk-score analytics over longitudinal event data, written for Apache Spark.

Every operator is a function ``DataFrame -> DataFrame`` with column names as parameters; pipelines are
built with ``DataFrame.transform`` and run as ordinary Catalyst plans.
"""

__version__ = "0.1.0"
