"""cohortlab — customer segmentation analytics as composable Spark DataFrame operators.

Layout:
  sources/    readers, writers and adapters from the test tables to canonical raw entities
  functions/  column-level helpers (pure Column -> Column) and fixed look-up values
  operators/  DataFrame -> DataFrame operators (cleaning, features, model, profiles, KPIs, ...)
  streaming/  stateful operators (batch fold + Structured Streaming twin)
  plans/      end-to-end batch job, query catalog and the SQL oracle twins
"""

__version__ = "0.1.0"

# Functions shipped to Python workers (pandas UDF bodies) are pickled by value, so executors
# do not need this package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to --py-files deployment
    pass
