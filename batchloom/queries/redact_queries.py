from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.redaction import (
    redact_columns,
    redact_json,
    redact_json_by_schema,
    redaction_audit,
)
from batchloom.queries.registry import query
from batchloom.queries.views import table


def event_details(events, *more):
    """Event properties as they might arrive: nested, with secrets at several depths."""
    text = F.format_string(
        '{"z": %s, "Prompt ": "%s", "nested": {"MY_API_KEY_2": "x", "label": "%s"}, '
        '"list": [{"full_prompt": "p", "n": %s}, 1, null]%s}',
        F.col("props"),
        F.col("event_type"),
        F.col("event_type"),
        F.col("user_id"),
        F.when(F.col("event_type") == "error", ', "password": "x"').otherwise(""),
    )
    return events.select("event_id", text.alias("details_json"), *more)


@query(
    "redact_props",
    """SELECT event_id, '{"list": [{"n": ' || user_id || '}, 1, null], "nested": {"label": "'
             || event_type || '"}, "z": ' || props || '}' AS details_json
    FROM events""",
)
def redact_props(spark, sf):
    return event_details(table(spark, sf, "events")).select(
        "event_id", redact_json(F.col("details_json")).alias("details_json")
    )


def event_objects(events, more):
    """Event properties that all have the same keys, but for `more` at the end of the list."""
    text = F.format_string(
        '{"z": %s, "Prompt ": "%s", "nested": {"MY_API_KEY_2": "x", "label": "%s"}, '
        '"list": [{"full_prompt": "p", "n": %s}%s]}',
        F.col("event_id"),
        F.col("event_type"),
        F.col("event_type"),
        F.col("user_id"),
        more,
    )
    return events.select("event_id", text.alias("details_json"))


@query(
    "redact_by_schema",
    """SELECT event_id, '{"list":[{"n":' || user_id || '}],"nested":{"label":"'
             || event_type || '"},"z":' || event_id || '}' AS details_json
    FROM events""",
)
def redact_by_schema(spark, sf):
    """Texts that all fit their common schema."""
    return redact_json_by_schema(event_objects(table(spark, sf, "events"), F.lit("")), "details_json")


@query(
    "redact_by_schema_mixed",
    """SELECT event_id, '{"list":[{"n":' || user_id || '}'
             || CASE event_type WHEN 'error' THEN ',1,null' ELSE '' END || '],"nested":{"label":"'
             || event_type || '"},"z":' || event_id || '}' AS details_json
    FROM events""",
)
def redact_by_schema_mixed(spark, sf):
    """A given schema that the errors among the events do not fit."""
    schema = T.StructType.fromDDL(
        "z bigint, `Prompt ` string, nested struct<MY_API_KEY_2:string, label:string>, "
        "list array<struct<full_prompt:string, n:bigint>>"
    )
    more = F.when(F.col("event_type") == "error", ", 1, null").otherwise("")
    return redact_json_by_schema(
        event_objects(table(spark, sf, "events"), more), "details_json", schema
    )


@query(
    "redaction_audit",
    """SELECT key, CASE key WHEN 'password' THEN count(*) FILTER (event_type = 'error')
                            ELSE count(*) END AS n_dropped
    FROM events, (VALUES ('prompt'), ('my_api_key_2'), ('full_prompt'), ('password')) k(key)
    GROUP BY key HAVING n_dropped > 0""",
)
def redaction_audit_query(spark, sf):
    return redaction_audit(event_details(table(spark, sf, "events")), "details_json")


@query(
    "redact_nested",
    """SELECT doc_id, '{"pages":[[{"no":' || n_chars || '}],[]],"origin":{"site":"' || source
             || '","languages":{"first":"' || lang || '"}}}' AS record
    FROM documents""",
)
def redact_nested(spark, sf):
    """Lists in lists, a map in a struct, and a struct of which nothing is left."""
    body = F.col("text")
    page = F.struct(body.alias("TEXT"), F.col("n_chars").alias("no"))
    languages = F.create_map(
        F.lit("first"), F.col("lang"), F.lit("Old_Credential"), body, F.lit(" Authorization"), body
    )
    record = F.struct(
        F.array(F.array(page), F.slice(F.array(page), 1, 0)).alias("pages"),
        F.struct(
            F.col("source").alias("site"), languages.alias("languages"), body.alias("refresh_token")
        ).alias("origin"),
        F.struct(body.alias("secret_box")).alias("vault"),
    )
    rows = table(spark, sf, "documents").select("doc_id", "text", record.alias("record"))
    return redact_columns(rows).withColumn("record", F.to_json("record"))
