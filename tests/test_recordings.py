"""What of the recordings' writers reaches the driver: the same few rows whatever the table's size."""

import pytest

from axisframe.queries import QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", ["bdf_samples", "brainvision_channels", "brainvision_floats", "brainvision_markers", "brainvision_samples", "edf_annotations", "edf_header", "edf_samples", "edf_span"])
def test_driver_rows_do_not_grow(spark, monkeypatch, name):
    def counted(real):
        def run(self, *args, **kwargs):
            got = real(self, *args, **kwargs)
            fetched[-1] += len(got)
            return got

        return run

    fetched, kind = [], type(spark.range(1))  # the class in use: what pyspark.sql.DataFrame defines is overridden there
    with monkeypatch.context() as m:
        for way in ("collect", "toPandas"):
            m.setattr(kind, way, counted(getattr(kind, way)))
        for folder in (DATA, "/root/testdata/sf0.01"):  # 1000 and 10,000 events
            fetched.append(0)
            QUERIES[name](spark, folder)
    assert fetched[0] == fetched[1] <= 16
