"""Lecture text, slide layout and classroom-event analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the small task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
