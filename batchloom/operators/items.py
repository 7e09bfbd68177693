"""Work items: one row per unit of work with id, content hash and token estimate, never text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.columns import text_hash, token_estimate, work_item_id
from batchloom.functions.redaction import DEFAULT_RULES, KeyRules, safe_json
from batchloom.schemas import BATCH_STATUSES, WORK_STATUSES


def derive_items(
    df: DataFrame,
    id_col: str,
    *,
    job_id: str | Column,
    text_col: str | None = None,
    hash_col: str | None = None,
    token_col: str | None = None,
    n_chars_col: str | None = None,
    metadata_cols: Sequence[str] = (),
    rules: KeyRules = DEFAULT_RULES,
) -> DataFrame:
    """Items of a record table; give a token column where one exists.

    Integer ids become `work_%06d` and the order of the items; other ids are kept as they are.
    Without `token_col` the estimate comes from `n_chars_col` or the text's length. Metadata keep no
    sensitive key at any depth, and their keys are sorted.
    """
    record = F.col(id_col)
    whole_number = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if token_col:
        tokens = F.col(token_col).cast("bigint")
    elif n_chars_col or text_col:
        tokens = token_estimate(F.col(n_chars_col) if n_chars_col else F.length(text_col))
    else:
        raise ValueError("give token_col, n_chars_col or text_col")
    if hash_col:
        content = F.col(hash_col)
    elif text_col:
        content = text_hash(F.col(text_col))
    else:
        content = F.lit(None).cast("string")
    return df.select(
        (F.lit(job_id) if isinstance(job_id, str) else job_id).alias("job_id"),
        (work_item_id(record) if whole_number else record.cast("string")).alias("work_item_id"),
        record.alias("ord"),
        record.cast("string").alias("external_id"),
        content.alias("input_text_hash"),
        tokens.alias("estimated_input_tokens"),
        safe_json(df, metadata_cols, rules).alias("metadata_json"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempt_count"),
    )


def split_oversize(
    items: DataFrame, hard_cap: int, token_col: str = "estimated_input_tokens"
) -> tuple[DataFrame, DataFrame]:
    """Items that fit a batch, and those over the hard cap."""
    fits = F.col(token_col) <= hard_cap
    return items.where(fits), items.where(~fits)


def reject_oversize(
    items: DataFrame,
    hard_cap: int,
    id_col: str = "work_item_id",
    token_col: str = "estimated_input_tokens",
) -> DataFrame:
    """The items unchanged; an item over the hard cap fails the query with its id and size."""
    tokens = F.col(token_col)
    message = F.format_string(
        f"work item %s has %d tokens, above hard cap {hard_cap}", F.col(id_col), tokens
    )
    checked = F.when(tokens > hard_cap, F.raise_error(message).cast(items.schema[token_col].dataType))
    return items.withColumn(token_col, checked.otherwise(tokens))


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule. `rules` maps a name to the condition a good row fulfils."""
    names = [
        F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*names))).alias("rule"))


def item_violations(items: DataFrame, keys: Sequence[str] = ("job_id", "work_item_id")) -> DataFrame:
    return violations(
        items,
        keys,
        {
            "tokens_positive": F.col("estimated_input_tokens") > 0,
            "status_known": F.col("status").isin(*WORK_STATUSES),
            "attempts_not_negative": F.col("attempt_count") >= 0,
        },
    )


def batch_violations(batches: DataFrame, keys: Sequence[str] = ("job_id", "batch_id")) -> DataFrame:
    return violations(
        batches,
        keys,
        {
            "tokens_not_negative": F.col("estimated_input_tokens") >= 0,
            "status_known": F.col("status").isin(*BATCH_STATUSES),
        },
    )
