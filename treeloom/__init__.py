"""Spark jobs over large collections of source trees: inventory, search, structure, graphs, bundles."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
