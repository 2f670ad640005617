"""Step-activity analytics on Spark: decode, normalize, sum per day, label per week, notify.

Every operator is a function from DataFrame to DataFrame. `plans.pipeline` chains them as batch
replay, `streaming.pipeline` runs the same rules as Structured Streaming.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
