"""Screening of repeated sensor measurements with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from gaugesieve.spec import MeasurementSpec

# Small vectorised helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MeasurementSpec"]
