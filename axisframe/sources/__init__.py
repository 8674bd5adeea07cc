"""Readers and stores of recordings."""

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats rawbin, edf, edf_annotations, brainvision and brainvision_markers known to ``spark.read.format``.

    Their readers take filters on channel and sample, which Spark must be told to hand to Python sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    from .brainvision import BrainVision, BrainVisionMarkers
    from .edf import Edf, EdfAnnotations
    from .rawbin import RawBin

    for source in (RawBin, Edf, EdfAnnotations, BrainVision, BrainVisionMarkers):
        spark.dataSource.register(source)
