"""Signs and light objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..functions.geo import c, rnd


def sign_height(size) -> Column:
    return F.coalesce(text.lookup(text.SIGN_HEIGHTS, c(size).cast("int")), F.lit(0.8))


def sign_type(raw, size) -> Column:
    """Decoded type; the largest signs always show the distance remaining."""
    return F.when(c(size) >= 4, 4).otherwise(text.decode_sign(raw)["signtype"])


def build_aerodromesign(signs: DataFrame) -> DataFrame:
    """``signs``: icao, x, y, heading, size, raw, source."""
    d = text.decode_sign("raw")
    return signs.select(
        "icao", sign_type("raw", "size").alias("signtype"), d["msgfront"].alias("msgfront"), d["msgback"].alias("msgback"),
        rnd("heading").alias("signdir"), "size", sign_height("size").alias("height"), "raw",
        F.lit(None).cast("boolean").alias("lighting"), "source", shapes.point_geom("x", "y").alias("geom"))
