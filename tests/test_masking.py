"""Masks against plain Python written from the rules."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from wardenlake.functions import masking as mk
from wardenlake.operators import anonymise


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def email(v):
    if "@" not in v:
        return v
    local, domain = v.split("@", 1)
    hidden = "*" * len(local) if len(local) <= 2 else local[0] + "*" * (len(local) - 2) + local[-1]
    return f"{hidden}@{domain}"


def phone(v):
    digits = re.sub(r"\D", "", v)
    if len(digits) < 4:
        return "*" * len(v)
    kept, seen = "", 0
    for ch in v:
        if ch.isdigit():
            seen += 1
            kept += ch if seen > len(digits) - 4 else "*"
        else:
            kept += ch
    return kept


def ssn(v):
    digits = re.sub(r"\D", "", v)
    return "***-**-" + digits[-4:] if len(digits) == 9 else "*" * len(v)


def card(v):
    digits = re.sub(r"\D", "", v)
    if len(digits) < 4:
        return "*" * len(v)
    masked = "*" * (len(digits) - 4) + digits[-4:]
    return " ".join(masked[i:i + 4] for i in range(0, len(masked), 4))


def free_text(v):
    for kind, function in (("email", email), ("phone", phone), ("ssn", ssn), ("credit_card", card)):
        v = re.sub(mk.FREE_TEXT_PATTERNS[kind].replace("(?U)", ""), lambda m: function(m.group()), v)
    return v


def test_single_masks(spark):
    rng = random.Random(3)
    values = ["ab@x.y", "a@b", "no-at", "abc@d@e", "555-123-4567", "+1 (555) 123-4567", "123", "", "12345678", "123-45-6789", "4242 4242 4242 4242", "424242424242424"]
    values += ["".join(rng.choice("0123456789-() abc@.") for _ in range(rng.randint(0, 22))) for _ in range(300)]
    for function, mask in ((email, mk.mask_email), (phone, mk.mask_phone), (ssn, mk.mask_ssn), (card, mk.mask_credit_card)):
        assert column(spark, values, mask) == [function(v) for v in values]


def test_options(spark):
    assert column(spark, ["jane@corp.example.com", "x@host"], lambda c: mk.mask_email(c, preserve_domain=False)) == ["j**e@****.example.com", "*@****"]
    assert column(spark, ["+1 (555) 123-4567"], lambda c: mk.mask_phone(c, preserve_format=False)) == ["*******4567"]
    assert column(spark, ["  Ada Lovelace", "", "  "], mk.anonymize_name) == ["A. [ANONYMIZED]", "", "  "]
    assert column(spark, ["12 Oak street, Town 12345", "Town"], lambda c: mk.anonymize_address(c, preserve_zip=True)) == [
        "[ADDRESS REDACTED], Town 12345, 12345", "Town"]
    assert column(spark, ["Bob", ""], lambda c: mk.anonymize_name(c, preserve_initial=False)) == ["[ANONYMIZED]", ""]


def test_free_text(spark):
    rng = random.Random(8)
    parts = ["jane@corp.example.com", "555-123-4567", "(555) 123 4567", "123-45-6789", "4242 4242 4242 4242", "4242424242424242", "text", "a@b.co", ",", "\n", " ", "7"]
    values = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    assert column(spark, values, mk.anonymize_text) == [free_text(v) for v in values]


def test_tokens_and_vault(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    vault = anonymise.token_vault(frame, "v", "s")
    assert {r["value"]: r["token"] for r in vault.collect()} == {v: hashlib.sha256(f"{v}s".encode()).hexdigest()[:16] for v in "ab"}
    tokens = frame.select(mk.hash_value(F.col("v"), "s").alias("token")).unionByName(spark.createDataFrame([("zz",)], "token string"))
    assert sorted(str(r["value"]) for r in anonymise.detokenize(tokens, "token", vault).collect()) == ["None", "None", "a", "a", "b"]


def test_batch_policies_and_report(spark):
    frame = spark.createDataFrame([("Jo Doe", "jo.d@x.org", "k1", "n")], "name string, mail string, key string, note string")
    policies = {"name": "name", "mail": "email", "key": "skip"}
    row = anonymise.batch_anonymize(frame, policies, "s").first()
    assert (row["name"], row["mail"], row["key"]) == ("J. [ANONYMIZED]", "j**d@x.org", "k1") and len(row["note"]) == 16
    report = {r["field"]: (r["rows_changed"], r["policy"]) for r in anonymise.anonymisation_report(frame, policies, "s").collect()}
    assert report == {"name": (1, "name"), "mail": (1, "email"), "key": (0, "skip"), "note": (1, "text")}
