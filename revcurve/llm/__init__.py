"""Operators for large-scale training-data preparation; nothing outside imports this package.

Its functions and classes travel to the executors by value, so a job needs no copy of the
package on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
