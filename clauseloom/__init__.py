"""clauseloom: multilingual clause, terminology and corpus analytics on Spark.

Every operator is a function from DataFrames to a DataFrame; little runs until
the caller asks for an action, but for steps that say so: they materialise what they
read more than once, or ask for counts of a bounded size.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
