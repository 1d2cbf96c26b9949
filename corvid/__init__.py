"""corvid: Spark-native claims analytics and classification features.

Subpackages
-----------
sources    scans and sinks
functions  column-expression helpers (built-in functions only)
operators  DataFrame -> DataFrame operators
plans      role bindings of the driver tables, flows, registered queries
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (such as the
# k-NN block scorer) are shipped by value, so executors need no copy of the package installed.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
