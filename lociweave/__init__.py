"""lociweave: genotype analytics and corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with the job: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
