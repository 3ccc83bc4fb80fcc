"""raterlab — annotation and model-label evaluation on Spark.

Every public function takes and returns DataFrames (or Columns); nothing is
collected except fixed-size summaries at the very end of a report.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (which may not have
    the package on their path) can run the scorer and the tail-probability UDFs."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 — older cloudpickle: fall back to by-reference pickling
        pass


_ship_by_value()
