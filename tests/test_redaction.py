import glob
import json

import pytest
from pyspark.sql import functions as F

from batchloom.functions.redaction import (
    DEFAULT_RULES,
    KeyRules,
    json_cleaner,
    redact_columns,
    redact_json,
    redact_json_by_schema,
    redaction_audit,
)
from batchloom.sources.tables import append_events, read_rows

# lists in lists, keys in odd cases, a sensitive key above harmless ones
DOCUMENT = {
    "Authorization ": "VEILED 1",
    "pages": [[{"TEXT": "VEILED 2", "no": 7}, {"no": 8}], [], ["loose"]],
    "secret_box": {"colour": "VEILED 3", "weights": [1, 2]},
    "sums": {"refresh_token": ["VEILED 4"], "euro": 12.5, "by_year": {"2024": {"old_credential": 0, "n": 3}}},
    "note": None,
}
CLEAN_DOCUMENT = {
    "pages": [[{"no": 7}, {"no": 8}], [], ["loose"]],
    "sums": {"euro": 12.5, "by_year": {"2024": {"n": 3}}},
    "note": None,
}


@pytest.mark.parametrize(
    "key, sensitive",
    [
        ("text", True),
        (" Prompt\t", True),
        ("MY_API_KEY_2", True),
        ("client_secret_id", True),
        ("credentials_path", True),
        ("bearer_token", True),
        ("context", False),
        ("token", False),
        ("input_text_hash", False),
    ],
)
def test_keys(spark, key, sensitive):
    assert DEFAULT_RULES.matches(key) is sensitive
    column = spark.range(1).select(DEFAULT_RULES.matches_column(F.lit(key)))
    assert column.first()[0] is sensitive


def test_json_is_cleaned_at_all_depths(spark):
    df = spark.createDataFrame(
        [(json.dumps(DOCUMENT),), ('[[{"prompt": {"a": 1}, "b": 2}], 5]',), ("{oops",), (None,), ("[]",)],
        "details string",
    )
    got = [r[0] for r in df.select(redact_json(F.col("details"))).collect()]
    assert got[0] == json.dumps(CLEAN_DOCUMENT, sort_keys=True)
    assert got[1:] == ['[[{"b": 2}], 5]', None, None, "[]"]
    counts = {r["key"]: r["n_dropped"] for r in redaction_audit(df, "details").collect()}
    assert counts == {
        "authorization": 1,
        "text": 1,
        "secret_box": 1,
        "refresh_token": 1,
        "old_credential": 1,
        "prompt": 1,
        "<not json>": 1,
    }


def test_structs_arrays_and_maps(spark):
    schema = (
        "doc long, PassWord string, body struct<"
        "pages: array<array<struct<Text: string, no: int>>>, "
        "offices: map<string, struct<town: string, door_credential: string>>, "
        "vault: struct<secret_a: string, prompt: string>, "
        "title: string, codes: map<int, string>>"
    )
    body = (
        [[("VEILED", 7), None], []],
        {"west": ("Oslo", "VEILED"), " Api_Key": ("Rome", "VEILED")},
        ("VEILED", "VEILED"),
        "open",
        {1: "one"},
    )
    df = spark.createDataFrame([(5, "VEILED", body), (6, None, None)], schema)
    clean = redact_columns(df)
    assert clean.columns == ["doc", "body"]
    assert clean.schema["body"].dataType.simpleString() == (
        "struct<pages:array<array<struct<no:int>>>,offices:map<string,struct<town:string>>,"
        "title:string,codes:map<int,string>>"
    )
    rows = {r["doc"]: r["body"] for r in clean.collect()}
    assert rows[6] is None
    assert rows[5].asDict(recursive=True) == {
        "pages": [[{"no": 7}, None], []],
        "offices": {"west": {"town": "Oslo"}},
        "title": "open",
        "codes": {1: "one"},
    }
    assert "Python" not in clean._jdf.queryExecution().toString()
    assert redact_columns(df, columns=["body"]).columns == ["doc", "PassWord", "body"]


def test_own_rules(spark):
    rules = KeyRules(keys=("ssn",), parts=("pin",))
    assert json_cleaner(rules)('{"ssn": 1, "Pin2": 2, "text": 3}') == '{"text": 3}'


def test_nothing_sensitive_reaches_the_files(spark, folder):
    log = spark.createDataFrame(
        [(11, "north", "e", "moved", json.dumps(DOCUMENT)), (12, "north", "e", "kept", None)],
        "event_id long, job_id string, event_type string, message string, details_json string",
    )
    for turn in range(2):
        append_events(log.withColumn("event_id", F.col("event_id") + 100 * turn), folder)
    files = glob.glob(f"{folder}/**/*.parquet", recursive=True)
    stored = b"".join(open(name, "rb").read() for name in files)
    assert files and b"VEILED" not in stored
    rows = {r["event_id"]: r["details_json"] for r in read_rows(spark, folder, "north").collect()}
    assert sorted(rows) == [11, 12, 111, 112] and rows[12] == "{}"
    assert json.loads(rows[111]) == CLEAN_DOCUMENT


def python_in(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" in plan or "Arrow" in plan


def test_json_by_schema(spark):
    fitting = [
        '{"b": 1, "a": {"token": "t", "secret_x": [1, 2]}, "l": [{"Password": 1, "n": 2}, {"n": 3}]}',
        '{"a": {"secret_x": [3]}, " PROMPT": "p"}',
        '{"a": {"token": "ü \\"quoted\\" \\\\ 中"}}',
        "{}",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fitting)], "id int, props string")
    done = redact_json_by_schema(df, "props")
    assert not python_in(done) and done.columns == ["id", "props"]
    clean = json_cleaner(compact=True)
    expected = [None if t is None else clean(t) for t in fitting]
    assert [r["props"] for r in done.orderBy("id").collect()] == expected
    assert json.loads(expected[0]) == {"a": {"token": "t"}, "b": 1, "l": [{"n": 2}, {"n": 3}]}

    odd = [
        '{"b": null}',  # an explicit null
        '{"b": "text of another kind", "api_key": 1}',
        '{"b": {"secret": 1, "c": 2}}',
        '{"unknown": {"password": 1}}',
        '{"b": 1, "b": 2}',
        '{"B": 1}',
        '[{"prompt": 1}, 2]',
        "5",
        "not json",
        "",
        '{"b": 1',
    ]
    schema = done.select(F.from_json("props", "b bigint, a struct<token:string,secret_x:array<int>>").alias("s"))
    schema = schema.schema["s"].dataType
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fitting + odd)], "id int, props string")
    for found in (redact_json_by_schema(df, "props", schema), redact_json_by_schema(df, "props")):
        assert [r["props"] for r in found.orderBy("id").collect()] == expected + [clean(t) for t in odd]
    assert redact_json_by_schema(df.limit(0), "props").collect() == []


def test_json_by_schema_without_a_common_one(spark):
    def redacted(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "props string")
        return sorted(str(r["props"]) for r in redact_json_by_schema(df, "props").collect())

    assert redacted('{"only": {"secret": 1}}') == ['{"only":{}}']
    assert redacted('{"secret": 1}', None) == ["None", "{}"]
    assert redacted('{"a": 1, "A": 2}') == ['{"A":2,"a":1}']
    assert redacted("[1]", '{"a": 1}') == ["[1]", '{"a":1}']
    assert redacted(None) == ["None"]
