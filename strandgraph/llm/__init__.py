"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Functions that run on executors
are shipped by value, so a cluster needs only numpy and pyarrow beside PySpark
(and the tokenizer library for the SentencePiece operator), not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
