"""Inclusion-exclusion: intersection and Jaccard similarity from three cardinalities."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def inclusion_exclusion(left: Column, right: Column, union: Column) -> Column:
    """struct<intersection, jaccard>: clamped to what is possible; two empty sets have Jaccard 1."""
    left, right, union = (x.cast("double") for x in (left, right, union))
    inter = F.least(F.greatest(left + right - union, F.lit(0.0)), left, right)
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(F.least(F.greatest(inter / union, F.lit(0.0)), F.lit(1.0)))
    return F.struct(inter.alias("intersection"), jaccard.alias("jaccard"))
