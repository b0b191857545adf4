"""skiff: fleet analytics on Spark.

Operators are plain ``DataFrame -> DataFrame`` functions built from
``pyspark.sql.functions``, windows and joins, so Catalyst plans them and
they scale out with the data.  Sub-packages:

* ``sources``   – readers for the raw layouts (logs, JSONL shards, reports)
                  and adapters from the driver's benchmark tables
* ``functions`` – scalar column expressions and percentile flavours
* ``operators`` – the transform library (as-of, islands, spans, prefix
                  offsets, band joins) and the domain operators
* ``plans``     – registered queries and their DuckDB oracle SQL
* ``streaming`` – Structured Streaming versions of the live operators
* ``sinks``     – writers (partitioned series, manifests, snapshots)
"""

from skiff.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
