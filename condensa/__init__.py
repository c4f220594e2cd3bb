"""Text-reduction analytics and training-data operators on PySpark.

Functions of this package are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
