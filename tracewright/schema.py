"""Units, parameters and schemas of point and lineage tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

#: Micrometres of one voxel step in z, y, x.
SCALE = (1.625, 0.40625, 0.40625)

NODES = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("target_id", T.LongType()),
        T.StructField("edge_prob", T.DoubleType()),
    ]
)
SUBMISSION_COLUMNS = ["id", "dataset", "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id"]


@dataclass
class Params:
    """Gates of the lineage operators, in micrometres unless named otherwise."""

    edge_max_um: float = 14.0
    match_um: float = 7.0
    division_parent_um: float = 10.5
    division_sister_um: float = 8.0
    gap_max: int = 1
    smooth_blend: float = 0.8
    prob_floor: float = 0.7
    node_weight: float = 0.1

    def override(self, values: dict[str, str]) -> Params:
        """A copy with values parsed to each field's type; ``0``, ``false`` and empty are false."""
        out = Params(**self.__dict__)
        for f in fields(self):
            if f.name in values:
                kind, raw = type(getattr(self, f.name)), values[f.name]
                setattr(out, f.name, raw.strip().lower() not in ("", "0", "false") if kind is bool else kind(raw))
        return out
