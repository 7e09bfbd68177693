"""Drop sensitive keys from nested columns and from JSON text. Values are never looked at."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that are dropped, and parts of keys that make any key sensitive.
SENSITIVE_KEYS = (
    "text",
    "raw_text",
    "paragraph_text",
    "prompt",
    "full_prompt",
    "api_key",
    "credential",
    "credentials",
    "secret",
    "password",
    "authorization",
    "access_token",
    "refresh_token",
    "bearer_token",
)
SENSITIVE_PARTS = ("api_key", "secret", "credential")

NOT_JSON = "<not json>"


@dataclass(frozen=True)
class KeyRules:
    """Which keys are sensitive, compared in lower case without surrounding blanks."""

    keys: Collection[str] = SENSITIVE_KEYS
    parts: Collection[str] = SENSITIVE_PARTS

    def matches(self, key: str) -> bool:
        name = key.strip().lower()
        return name in self.keys or any(part in name for part in self.parts)

    def matches_column(self, key: Column) -> Column:
        name = F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))
        found = name.isin(list(self.keys))
        for part in self.parts:
            found = found | name.contains(part)
        return found


DEFAULT_RULES = KeyRules()


def redact_columns(
    df: DataFrame, columns: Sequence[str] | None = None, rules: KeyRules = DEFAULT_RULES
) -> DataFrame:
    """Drop sensitive fields and map keys at any depth, as plain expressions.

    With `columns` only those are looked into; otherwise all, and sensitive columns themselves go.
    A struct left without fields is dropped, since Parquet cannot hold it.
    """
    selected = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if columns is None and rules.matches(field.name):
            continue
        if columns is None or field.name in columns:
            column = _without_sensitive(column, field.dataType, rules)
        if column is not None:
            selected.append(column.alias(field.name))
    return df.select(*selected)


def safe_json(
    df: DataFrame, columns: Sequence[str], rules: KeyRules = DEFAULT_RULES
) -> Column:
    """The columns as one JSON object without sensitive keys, keys sorted, both at every depth."""
    kept = []
    for name in sorted(set(columns)):
        if rules.matches(name):
            continue
        kind = df.schema[name].dataType
        column = _without_sensitive(F.col(f"`{name}`"), kind, rules)
        if column is not None:
            kept.append(_sorted_keys(column, _kept_type(kind, rules)).alias(name))
    return F.to_json(F.struct(*kept)) if kept else F.lit("{}")


def _kept_type(kind: T.DataType, rules: KeyRules) -> T.DataType:
    """The type that `_without_sensitive` leaves of a type that it does not drop."""
    if isinstance(kind, T.StructType):
        return T.StructType(
            [
                T.StructField(f.name, _kept_type(f.dataType, rules))
                for f in kind.fields
                if not rules.matches(f.name)
                and _without_sensitive(F.lit(None), f.dataType, rules) is not None
            ]
        )
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_kept_type(kind.elementType, rules))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _kept_type(kind.valueType, rules))
    return kind


def _sorted_keys(column: Column, kind: T.DataType) -> Column:
    """Struct fields by name and map entries by key, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = [_sorted_keys(column.getField(f.name), f.dataType).alias(f.name) for f in fields]
        return F.when(column.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(
            F.map_entries(column),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
        return F.transform_values(
            F.map_from_entries(entries), lambda _, x: _sorted_keys(x, kind.valueType)
        )
    return column


def _without_sensitive(column: Column, kind: T.DataType, rules: KeyRules) -> Column | None:
    if not _may_hold_keys(kind):
        return column
    if isinstance(kind, T.StructType):
        fields = []
        for field in kind.fields:
            if rules.matches(field.name):
                continue
            inner = _without_sensitive(column.getField(field.name), field.dataType, rules)
            if inner is not None:
                fields.append(inner.alias(field.name))
        if not fields:
            return None
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        if _without_sensitive(F.lit(None), kind.elementType, rules) is None:
            return None
        return F.transform(column, lambda x: _without_sensitive(x, kind.elementType, rules))
    kept = column
    if isinstance(kind.keyType, T.StringType):
        kept = F.map_filter(column, lambda key, _: ~rules.matches_column(key))
    if _without_sensitive(F.lit(None), kind.valueType, rules) is None:
        return None
    return F.transform_values(kept, lambda _, x: _without_sensitive(x, kind.valueType, rules))


def _may_hold_keys(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def json_cleaner(
    rules: KeyRules = DEFAULT_RULES, compact: bool = False
) -> Callable[[str], str | None]:
    """A function that drops sensitive keys from JSON text and sorts the others.

    Keys are dropped while the parser builds its objects. Text that is not JSON becomes null.
    `compact` text has no blanks and no escapes but those that are needed.
    """
    style = {"separators": (",", ":"), "ensure_ascii": False} if compact else {}
    known: dict[str, bool] = {}

    def keep(pairs: list[tuple[str, object]]) -> dict:
        kept = {}
        for key, value in pairs:
            sensitive = known.get(key)
            if sensitive is None:
                sensitive = rules.matches(key)
                if len(known) < 10_000:
                    known[key] = sensitive
            if not sensitive:
                kept[key] = value
        return kept

    def clean(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text, object_pairs_hook=keep), sort_keys=True, **style)
        except (ValueError, RecursionError):
            return None

    return clean


def sensitive_keys(value: object, rules: KeyRules = DEFAULT_RULES) -> list[str]:
    """Normalised names of the keys that are dropped; what lies below them is not looked at."""
    if isinstance(value, dict):
        found = [key.strip().lower() for key in value if rules.matches(key)]
        inner = [v for key, v in value.items() if not rules.matches(key)]
    else:
        found, inner = [], value if isinstance(value, list) else []
    for part in inner:
        found += sensitive_keys(part, rules)
    return found


def _per_distinct_value(texts: pd.Series, fn) -> pd.Series:
    """Apply `fn` once per distinct text of an Arrow batch; metadata repeats a lot."""
    codes, distinct = pd.factorize(texts)
    values = pd.Series([fn(text) for text in distinct] + [None], dtype=object)
    return values.take(codes).reset_index(drop=True)  # code -1, null, takes the last one


def redact_json(
    column: Column, rules: KeyRules = DEFAULT_RULES, compact: bool = False
) -> Column:
    """JSON text without sensitive keys, keys sorted. Text that is not JSON becomes null."""

    clean = json_cleaner(rules, compact)

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return _per_distinct_value(texts, clean)

    return redact(column)


def json_schema(df: DataFrame, column: str) -> T.StructType | None:
    """The fields of all JSON objects of a column, found in one aggregation; None if there is no common one.

    Where values differ in kind the type is string, which such values do not survive unchanged.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`")))).first()[0]
    try:
        kind = T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))
    except Exception:  # names that do not read back as a type
        return None
    kind = _with_strings(kind)
    return kind if isinstance(kind, T.StructType) else None


def _with_strings(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_strings(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_strings(kind.elementType))
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def _readable(kind: T.DataType, rules: KeyRules) -> bool:
    """Whether fields can be told apart in SQL, and no struct is left without any."""
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        kept = [f for f in kind.fields if not rules.matches(f.name)]
        return bool(kept) and len(set(names)) == len(names) and all(
            _readable(f.dataType, rules) for f in kept
        )
    return not isinstance(kind, T.ArrayType) or _readable(kind.elementType, rules)


def redact_json_by_schema(
    df: DataFrame, column: str, schema: T.StructType | None = None, rules: KeyRules = DEFAULT_RULES
) -> DataFrame:
    """`df` with the sensitive keys of a JSON column dropped, as compact text with sorted keys.

    Texts are read by a schema (given, or found in one pass), redacted as nested columns and written again,
    without Python. A text that the schema does not hold unchanged (another kind of value, an
    explicit null, a key that is there twice or unknown) is found by comparing both as parsed JSON, and cleaned
    by the parser of `redact_json`. One pass looks whether there are such texts; if not, the plan has
    no Python. Null stays null and text that is not JSON becomes null. An empty table stays empty.
    """
    text = F.col(f"`{column}`")
    python = redact_json(text, rules, compact=True)
    schema = json_schema(df, column) if schema is None else schema
    if schema is None or not _readable(schema, rules):
        return df.withColumn(column, python)
    plain = lambda json: F.to_json(F.try_parse_json(json))
    typed = F.from_json(text, schema)
    fits = text.isNull() | F.coalesce(plain(text) == plain(F.to_json(typed)), F.lit(False))
    redacted = plain(F.to_json(_without_sensitive(typed, schema, rules)))
    if df.where(~fits).isEmpty():
        return df.withColumn(column, redacted)
    rest = redact_json(F.when(~fits, text), rules, compact=True)
    return df.withColumn(column, F.when(fits, redacted).otherwise(rest))


def dropped_keys(column: Column, rules: KeyRules = DEFAULT_RULES) -> Column:
    """The keys `redact_json` drops, once per occurrence."""

    def find(text: str) -> list[str]:
        try:
            return sensitive_keys(json.loads(text), rules)
        except (ValueError, RecursionError):
            return [NOT_JSON]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def audit(texts: pd.Series) -> pd.Series:
        return _per_distinct_value(texts, find)

    return audit(column)


def redaction_audit(
    df: DataFrame, column: str, rules: KeyRules = DEFAULT_RULES
) -> DataFrame:
    """How often each sensitive key occurs."""
    return (
        df.select(F.explode(dropped_keys(F.col(column), rules)).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n_dropped"))
    )
