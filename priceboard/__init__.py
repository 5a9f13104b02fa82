"""PySpark operators for retail price boards, traffic reports and subscriber tables."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with their code, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
