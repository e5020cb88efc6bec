"""Spark-native text stylometry: features, scoring, cue rubric, training and evaluation."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers carry their code with them: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
