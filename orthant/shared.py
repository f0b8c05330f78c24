"""Broadcast of objects of this package's own classes.

Spark pickles broadcasts by reference, so workers would have to import the package; these travel by value, as
functions do, and need no installed copy. A task unpickles the value once.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    def __init__(self, spark: SparkSession, value: object):
        self._data, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_data": self._data, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._data.value)
        return self._value

    def drop(self) -> None:
        """Gives the value's memory back; it is loaded again when it is asked for."""
        self._value = None
        self._data.__dict__.pop("_value", None)


def share(spark: SparkSession, value: object) -> Shared:
    return Shared(spark, value)
