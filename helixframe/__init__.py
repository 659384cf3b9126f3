"""helixframe: declarative PySpark operators for genotype, ontology and text analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
