"""A PySpark-native engine for analysing the topology of software systems.

Python functions that run on executors are shipped by value, so a cluster needs
only PySpark, pandas, numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
