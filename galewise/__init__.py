"""Retrieval, ranking, forecast calibration and tree models as Spark jobs.

Functions given to ``mapInPandas`` are pickled with their code, so executors need
numpy and pandas but not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
