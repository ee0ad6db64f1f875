"""Schemas of the file formats; nothing is inferred at read time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

D, S, I, L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def results(layers: Sequence[str]) -> T.StructType:
    """Wide result table: location, then density and layers for X and for Y."""
    return _struct(("location", D), *[(f"{c}_{a}", D) for a in "XY" for c in ("densities", *layers)])


DENSITY_PROFILE = _struct(("ecc", D), *[(f"{c}_{a}", D) for a in "XY" for c in ("dens", "dens_smthd", "dens_fit")])
DENSITY_RAW = _struct(("ecc", D), ("density", D))
BASELINE = _struct(("subject_id", I), ("laterality", S), ("birth_date", T.DateType()), ("visit_date", T.DateType()), ("axial_right", D),
                   ("axial_left", D), ("sphere_right", D), ("sphere_left", D), ("sex", S))
PARAMETERS = _struct(("param", S), ("value", S))
POSITION_LUT = _struct(("img", S), ("X", D), ("Y", D), ("range", D))
COMPONENTS = _struct(("name", S), ("x", S), ("y", D), ("image_size", S), ("i", I), ("angle", D))
REGISTRATION = _struct(("image", L), ("dx", D), ("dy", D), ("score", D))
VECTOR = T.MapType(S, T.MapType(S, _struct(("vector", T.ArrayType(D)))))
LAYER_DOC = _struct(("study", T.MapType(S, VECTOR)), ("spacing", _struct(("x", D), ("y", D), ("z", D))))
SLICE_DOC = _struct(("study", T.MapType(S, T.MapType(S, _struct(("vector", T.ArrayType(D)))))))
DATASET = _struct(("info", _struct(("id", L), ("laterality", S), ("layerVariants", T.ArrayType(S)))),
                  ("oct", _struct(("info", _struct(("spacing", _struct(("x", D), ("y", D), ("z", D))))))),
                  ("tvss", T.MapType(S, T.ArrayType(D))), ("cvis", T.MapType(S, T.ArrayType(D))))
BROWSE = T.MapType(S, T.MapType(S, T.ArrayType(DATASET)))
