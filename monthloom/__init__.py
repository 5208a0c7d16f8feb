"""monthloom: monthly-series analytics on Spark DataFrames.

Two table shapes are used throughout:

* *long*   ``product STRING, ds DATE, y DOUBLE`` - one row per product and month;
* *packed* ``product STRING, start DATE, n INT, ys ARRAY<DOUBLE>`` - one row per
  product, the months in order.  A series has as many entries as there are months
  in its window, so a packed row is small however many products there are.

Raw facts of any size enter through :func:`monthloom.operators.calendar.to_monthly`,
which aggregates map-side first; from there on work is partitioned by product.
"""

__version__ = "0.1.0"


def _travel_by_value() -> None:
    """Let kernels carry their code to the executors, where this package need not be installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_travel_by_value()
