import hashlib
import json

import pytest
from pyspark.sql import functions as F

from batchloom.operators.items import batch_violations, derive_items, item_violations


def test_no_sensitive_key_at_any_depth(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "HIDDEN text")], "id long, body string").select(
        "id",
        F.struct(F.col("body").alias("Raw_Text"), F.lit(1).alias("b"), F.lit(2).alias("a")).alias("info"),
        F.array(F.array(F.struct(F.col("body").alias("prompt"), F.lit(3).alias("n")))).alias("lists"),
        F.create_map(F.lit("z"), F.lit(1), F.lit("my_secret_code"), F.lit(2), F.lit("c"), F.lit(3)).alias("tags"),
        F.struct(F.col("body").alias("api_key")).alias("only_hidden"),
        F.col("body").alias("password"),
    )
    columns = ["tags", "info", "lists", "only_hidden", "password"]
    row = derive_items(df, "id", job_id="j", token_col="id", metadata_cols=columns).first()
    assert row["metadata_json"] == '{"info":{"a":2,"b":1},"lists":[[{"n":3}]],"tags":{"c":3,"z":1}}'


def test_items_carry_no_text(spark):
    df = spark.createDataFrame(
        [(7, "héllo", "en", "s3cret"), (12, "", "de", "x")],
        "id long, text string, lang string, api_key string",
    )
    items = derive_items(
        df, "id", job_id="job", text_col="text", metadata_cols=["text", "lang", "api_key"]
    )
    rows = {r["ord"]: r for r in items.collect()}
    first = rows[7]
    assert first["work_item_id"] == "work_000007" and first["external_id"] == "7"
    assert first["input_text_hash"] == hashlib.sha256("héllo".encode()).hexdigest()
    assert (first["estimated_input_tokens"], rows[12]["estimated_input_tokens"]) == (2, 1)
    assert json.loads(first["metadata_json"]) == {"lang": "en"}
    assert (first["status"], first["attempt_count"]) == ("pending", 0)
    assert "s3cret" not in str(items.collect()) and "héllo" not in str(items.collect())


def test_given_estimates_and_text_ids(spark):
    df = spark.createDataFrame([("a-1", 50)], "id string, tokens int")
    row = derive_items(df, "id", job_id=F.lit("j"), token_col="tokens").first()
    assert (row["work_item_id"], row["estimated_input_tokens"]) == ("a-1", 50)
    assert row["input_text_hash"] is None
    with pytest.raises(ValueError):
        derive_items(df, "id", job_id="j")


def test_violations(spark):
    items = spark.createDataFrame(
        [("j", "ok", 1, "pending", 0), ("j", "bad", 0, "lost", -1), ("j", "null", None, None, 0)],
        "job_id string, work_item_id string, estimated_input_tokens long, status string, "
        "attempt_count int",
    )
    got = sorted((r["work_item_id"], r["rule"]) for r in item_violations(items).collect())
    assert got == [
        ("bad", "attempts_not_negative"),
        ("bad", "status_known"),
        ("bad", "tokens_positive"),
        ("null", "status_known"),
        ("null", "tokens_positive"),
    ]
    batches = spark.createDataFrame(
        [("j", "b1", 0, "queued"), ("j", "b2", -5, "ready")],
        "job_id string, batch_id string, estimated_input_tokens long, status string",
    )
    assert {(r["batch_id"], r["rule"]) for r in batch_violations(batches).collect()} == {
        ("b2", "tokens_not_negative"),
        ("b2", "status_known"),
    }
