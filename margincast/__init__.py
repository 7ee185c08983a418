"""margincast — weekly demand cube, demand models and price search on Spark.

Every public function maps DataFrame(s) to a DataFrame using Spark's own
functions; nothing is collected to the driver except bounded metadata
(e.g. per-partition counts, a handful of split points).
"""

from margincast.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
