"""Checks of tables at the edges of the library: names, types, keys and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Spec:
    required: dict[str, str]  # name -> type
    optional: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    values: dict[str, tuple] = field(default_factory=dict)


OBSERVATION_SPEC = Spec({"src_id": "any", "dst_id": "any", "y": "number"}, {"src_context": "any", "dst_context": "any", "ctx_id": "any"}, ("src_id", "dst_id", "y"))
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def validate(df: DataFrame, spec: Spec, allow_others: bool = True) -> DataFrame:
    """df itself if it fits, else ValueError. Names and types cost nothing; nulls, values and keys one aggregate each at most."""
    types = dict(df.dtypes)
    if lacking := [c for c in spec.required if c not in types]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    if not allow_others and (more := [c for c in types if c not in spec.required and c not in spec.optional]):
        raise ValueError(f"columns are unknown: {', '.join(more)}")
    for name, kind in (spec.required | spec.optional).items():
        if name in types and kind != "any" and not (types[name].startswith(_NUMBERS) if kind == "number" else types[name] == kind):
            raise ValueError(f"{name} is {types[name]}, not {kind}")
    checks = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"{c} is null") for c in spec.not_null]
    checks += [F.sum(F.when(~F.col(c).isin(*v), 1).otherwise(0)).alias(f"{c} has another value") for c, v in spec.values.items() if c in types]
    if checks:
        for what, n in df.agg(*checks).first().asDict().items():
            if n:
                raise ValueError(f"{what} in {n} rows")
    if spec.unique and not df.groupBy(*spec.unique).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(spec.unique)} is not unique")
    return df


def binary_labels(df: DataFrame, y: str) -> DataFrame:
    """Labels -1 and 1 become 0 and 1; others are an error."""
    label = F.when(F.col(y) == -1, 0.0).when(F.col(y).isin(0, 1), F.col(y).cast("double")).otherwise(F.raise_error(F.lit("labels must be 0 and 1 or -1 and 1")).cast("double"))
    return df.withColumn(y, label)


def unmatched(df: DataFrame, column: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Values of a column that a list of ids lacks."""
    return df.select(F.col(column).alias(id_col)).distinct().join(ids.select(id_col).distinct(), id_col, "left_anti")


def same_features(train: list[str], test: list[str]) -> None:
    if train != test:
        raise ValueError("training and test features differ")
