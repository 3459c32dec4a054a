"""Column-expression helpers (all JVM-side ``pyspark.sql.functions``)."""

from shelfsense.functions.scalar import *  # noqa: F401,F403
