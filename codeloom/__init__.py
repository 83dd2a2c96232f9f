"""codeloom: call graphs, rankings and checked documentation for source code, on Spark.

Every relation carries a ``repo`` column, so one run analyses a whole corpus
of repositories; a single repository is the corpus with one ``repo`` value.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run in tasks travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
