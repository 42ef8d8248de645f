"""The forecast steps are fitted at the same time."""

import threading

from pyspark.sql import functions as F

from gridlight.operators import ml


def test_steps_are_fitted_together(spark, monkeypatch):
    meet = threading.Barrier(3, timeout=30)

    class Waiting:
        def __init__(self, stages):
            pass

        def fit(self, data):
            meet.wait()
            return data.agg(F.max("label")).first()[0]

    monkeypatch.setattr(ml, "Pipeline", Waiting)
    frame = spark.createDataFrame([([5.0, 7.0, 6.0],), ([1.0, 2.0, 9.0],)], "y array<double>")
    assert ml.fit_horizons(frame, 0, [1, 2, 3]) == {1: 5.0, 2: 7.0, 3: 9.0}
