"""Names and types of the ensemble tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: State variables in their fixed order: mixing ratios (kg/kg), temperature (K), pressure (Pa), wind (m/s).
VARIABLES = ("qg", "qr", "qs", "t", "p", "u", "v", "w")
#: The variables that the forward operator reads.
REFLECTIVITY_INPUTS = ("qr", "qs", "qg", "t", "p")
POINT = ("i", "j", "k")


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in pairs]


_point = _fields(*((x, T.IntegerType()) for x in POINT))
STATE = T.StructType([*_point, T.StructField("m", T.IntegerType()), *_fields(*((x, T.DoubleType()) for x in VARIABLES))])
GRID = T.StructType([*_point, *_fields(("x_km", T.DoubleType()), ("y_km", T.DoubleType()), ("z_km", T.DoubleType()))])
COMBOS = T.StructType(_fields(("combo_id", T.IntegerType()), ("method", T.StringType()), ("ntemp", T.IntegerType()), ("alpha_s", T.DoubleType()), ("lx", T.DoubleType()), ("ly", T.DoubleType()), ("lz", T.DoubleType())))
