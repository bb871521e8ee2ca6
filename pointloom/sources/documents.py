"""Strict JSON and the tables of element models and annotations."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SCHEMA_VERSION = 2
#: Tables of an element model and their typed columns.
MODEL = {
    "storeys": "id string, name string, elevation double, ceiling double, footprint array<struct<x: double, y: double>>",
    "walls": "id string, storey_id string, start struct<x: double, y: double>, end struct<x: double, y: double>, base double, height double, thickness double, classification string, evidence_count long, fit_rmse_m double, review_state string",
    "slabs": "id string, storey_id string, footprint array<struct<x: double, y: double>>, base double, thickness double, kind string, confidence double, review_state string",
    "slab_openings": "id string, host_slab_id string, start struct<x: double, y: double>, end struct<x: double, y: double>, width double, source_stair_id string, source_system_id string, ifc_cut_approved boolean",
    "spaces": "id string, storey_id string, footprint array<struct<x: double, y: double>>, base double, height double",
    "openings": "id string, host_wall_id string, kind string, offset double, sill double, width double, height double, confidence double",
    "stairs": "id string, storey_id string, start struct<x: double, y: double>, end struct<x: double, y: double>, base double, width double, rise double, going double, steps int, system_id string, flight_index int",
    "landings": "id string, storey_id string, footprint array<struct<x: double, y: double>>, base double, thickness double, system_id string, connected_stair_ids array<string>",
}


def read_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(name):
        raise ValueError(f"{name} is not allowed")

    def number(s):
        v = float(s)
        if not math.isfinite(v):
            raise ValueError(f"{s} is not finite")
        return v

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse, parse_float=number)


def canonical(value) -> str:
    """Sorted keys, no spaces, no NaN: equal values have equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def model_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The eight tables of an element model document; unknown keys and other versions or units are refused."""
    doc = read_json(text)
    if doc.get("schema_version") != SCHEMA_VERSION or doc.get("unit") != "metre":
        raise ValueError("unknown version or unit")
    if extra := set(doc) - set(MODEL) - {"schema_version", "unit", "metadata"}:
        raise ValueError(f"unknown collections: {sorted(extra)}")
    out = {}
    for name, ddl in MODEL.items():
        schema = T._parse_datatype_string(ddl)
        known = set(schema.fieldNames())
        rows = doc.get(name, [])
        for r in rows:
            if bad := set(r) - known:
                raise ValueError(f"unknown fields in {name}: {sorted(bad)}")
        out[name] = spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema, verifySchema=True)
    return out
