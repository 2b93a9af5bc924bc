"""Name standardisation, dedupe and fuzzy matching as Spark jobs."""

import sys as _sys

try:  # functions of this package travel with their tasks: executors need not have it installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass
