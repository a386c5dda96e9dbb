"""Fixed schemas of the tables the engine itself writes."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _d, _b = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_ts = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


REGISTRY = _struct(
    ("dataset", _s), ("table_name", _s), ("layer", _s), ("batch_column", _s)
)

TOP_ENTRY = _struct(("value", _s), ("count", _l))

PROFILE_COLUMN = _struct(
    ("dataset", _s), ("table_name", _s), ("batch_id", _s),
    ("column_name", _s), ("type", _s), ("position", _i), ("row_count", _l),
    ("null_count", _l), ("null_rate", _d), ("distinct", _l),
    ("min", _s), ("max", _s), ("role", _s), ("measure", _s),
    ("k", _i), ("coverage", _d), ("top", T.ArrayType(TOP_ENTRY)),
    ("numeric_count", _l), ("numeric_rate", _d), ("median", _d), ("mad", _d),
    ("numeric_min", _d), ("numeric_max", _d),
    ("amplitude_jours", _l), ("retard_jours", _l), ("dates_futures", _l),
)

PROFILE_METRIC = _struct(
    ("dataset", _s), ("table_name", _s), ("batch_id", _s),
    ("column_name", _s), ("metric", _s), ("value", _d),
)

SCHEMA_HISTORY = _struct(
    ("batch_id", _s), ("table_name", _s), ("column_name", _s),
    ("ordinal_position", _i), ("captured_at", _ts),
)

ANOMALY = _struct(
    ("family", _s), ("table_name", _s), ("batch_id", _s), ("column_name", _s),
    ("type", _s), ("observed", _s), ("reference", _s),
    ("observed_num", _d), ("reference_num", _d),
    ("observed_values", T.ArrayType(_s)), ("magnitude", _d), ("dama", _s),
    ("details", T.MapType(_s, _s)),
)

CONTRACT_CLAUSE = _struct(
    ("dataset", _s), ("table_name", _s), ("version", _i), ("status", _s),
    ("approved_by", _s), ("source_batch_id", _s), ("source_row_count", _l),
    ("column_name", _s), ("role", _s), ("clause", _s), ("bool_arg", _b),
    ("lo", _d), ("hi", _d), ("values", T.ArrayType(_s)),
)

CONTRACT_WARNING = _struct(
    ("dataset", _s), ("table_name", _s), ("version", _i),
    ("column_name", _s), ("kind", _s), ("detail", _s),
)

INCIDENT = _struct(
    ("incident_id", _s), ("run_ts", _ts), ("dataset", _s), ("layer", _s),
    ("table_name", _s), ("batch_id", _s), ("anomalies", _s),
    ("signatures", T.ArrayType(_s)), ("diagnosis", _s), ("proposed_fix", _s),
    ("human_decision", _s), ("decided_by", _s), ("decided_at", _ts),
    ("applied_fix", _s), ("validation_status", _s), ("duration_s", _d),
)

EXPECTED_ANOMALY = _struct(
    ("anomaly_id", _s), ("table_name", _s), ("column_name", _s), ("type", _s),
    ("batch_id", _s), ("rate", _d),
)

CHECK = _struct(
    ("table_name", _s), ("column_name", _s), ("kind", _s),
    ("values", T.ArrayType(_s)), ("parent_table", _s), ("parent_column", _s),
    ("tags", T.ArrayType(_s)),
)

CHECK_RESULT = _struct(
    ("test", _s), ("table_name", _s), ("column_name", _s), ("kind", _s),
    ("dama", _s), ("failures", _l), ("status", _s), ("tags", T.ArrayType(_s)),
)

# one typed correction: which rows (match) and what to do with them (gesture)
CORRECTION = _struct(
    ("table_name", _s), ("batch_id", _s), ("column_name", _s), ("gesture", _s),
    ("match", _s), ("lo", _d), ("hi", _d), ("values", T.ArrayType(_s)),
    ("target", _s), ("whole_column", _b), ("by_person", _b),
)
