"""Column masking, tokenisation and the token vault over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.functions import masking as mk


def policy_column(name: str, policy: str, salt: str) -> Column:
    """``skip``, ``token``, ``hash`` or a format name; any other name hashes."""
    value = F.col(name).cast("string")
    if policy == "skip":
        return F.col(name)
    if policy in ("token", "hash"):
        return mk.hash_value(value, salt)
    return mk.by_format(value, policy, salt)


def batch_anonymize(df: DataFrame, policies: dict[str, str], salt: str) -> DataFrame:
    """Apply one policy per column; columns without a policy are hashed."""
    return df.select(*[policy_column(c, policies.get(c, "text"), salt).alias(c) for c in df.columns])


def token_vault(df: DataFrame, column: str, salt: str) -> DataFrame:
    """value → token, one row per distinct value."""
    values = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.withColumn("token", mk.hash_value(F.col("value"), salt))


def detokenize(df: DataFrame, token_column: str, vault: DataFrame, out: str = "value") -> DataFrame:
    """Left join to the vault; unknown tokens give null.

    Skew: a popular token may hold a third of the rows.  AQE splits that
    partition, and the vault side has one row per token, so splitting is exact.
    """
    known = vault.select(F.col("token").alias("_token"), F.col("value").alias(out))
    return df.join(known, df[token_column] == known["_token"], "left").drop("_token")


def anonymisation_report(df: DataFrame, policies: dict[str, str], salt: str) -> DataFrame:
    """Per field: rows, changed rows, lengths before and after, detected kind, policy."""
    fields = df.columns
    policy = {c: policies.get(c, "text") for c in fields}
    before = {c: F.col(c).cast("string") for c in fields}
    after = {c: policy_column(c, policy[c], salt).cast("string") for c in fields}
    exprs = []
    for c in fields:
        exprs += [
            F.count(F.lit(1)).alias(f"{c}|rows"),
            F.sum(F.when(before[c].eqNullSafe(after[c]), 0).otherwise(1)).alias(f"{c}|changed"),
            F.sum(F.length(before[c])).alias(f"{c}|original_length"),
            F.sum(F.length(after[c])).alias(f"{c}|anonymized_length"),
        ]
    wide = df.agg(*exprs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.lit(policy[c]).alias("policy"),
            F.col(f"`{c}|rows`").alias("rows_processed"), F.col(f"`{c}|changed`").alias("rows_changed"),
            F.col(f"`{c}|original_length`").alias("original_length"),
            F.col(f"`{c}|anonymized_length`").alias("anonymized_length"))
        for c in fields])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def change_kind(original: Column, changed: Column) -> Column:
    """What the output looks like: none, masking, hash, partial_mask or unknown."""
    return (
        F.when(changed == original, "none")
        .when(changed.startswith("[ANONYMIZED]") | (changed == "[ADDRESS REDACTED]"), "masking")
        .when(changed.rlike("^[a-f0-9]+$"), "hash")
        .when(changed.contains("*"), "partial_mask")
        .otherwise("unknown"))


def vault_statistics(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("total_tokens"), F.countDistinct("token").alias("reversible_tokens"))
