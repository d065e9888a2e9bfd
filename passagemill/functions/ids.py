"""Deterministic identifiers: the same input row always gets the same id."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """UUID-shaped md5 of the parts, so that a retried task writes the same id."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])

