"""shelfsense: retail assortment and pricing analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` that answers
all keys (every store, cluster, category, period or product) in one
distributed job.  Nothing here creates a SparkSession except
:mod:`shelfsense.session`, which is for tests, the bench and scripts.
"""

__version__ = "0.2.0"
