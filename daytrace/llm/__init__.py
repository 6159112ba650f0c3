"""Operators for training-data pipelines: scoring, classification, deduplication, extraction and mixing."""

import sys

from pyspark import cloudpickle

# Tasks get these modules' functions with the job, so that executors need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
