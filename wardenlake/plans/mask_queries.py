"""Masking and tokenisation over customers, suppliers, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.functions import masking as mk
from wardenlake.operators import anonymise
from wardenlake.plans.registry import derive, plain, query
from wardenlake.sources.tables import load, spread

SALT = "fixed-salt"

# Contact values per customer in every shape the masks tell apart.
CONTACTS = """
SELECT c_custkey, c_name,
       CASE c_custkey % 4 WHEN 0 THEN concat('ab@', lower(c_mktsegment), '.example.com')
            WHEN 1 THEN concat('customer.', cast(c_custkey AS string), '@mail.example.org')
            WHEN 2 THEN concat('c', cast(c_custkey AS string), '@localhost') ELSE concat('no-at-', cast(c_custkey AS string)) END AS email,
       CASE c_custkey % 4 WHEN 0 THEN concat('+1 (', cast(200 + c_nationkey AS string), ') 555-', cast(1000 + c_custkey % 9000 AS string))
            WHEN 1 THEN concat(cast(200 + c_nationkey AS string), '.555.', cast(1000 + c_custkey % 9000 AS string))
            WHEN 2 THEN cast(5550000000 + c_custkey AS string) ELSE concat('x', cast(c_custkey % 10 AS string)) END AS phone,
       CASE WHEN c_custkey % 5 = 0 THEN '12-345' ELSE concat('123-4', cast(c_custkey % 10 AS string), '-', cast(1000 + c_custkey % 9000 AS string)) END AS ssn,
       CASE WHEN c_custkey % 6 = 0 THEN '42' ELSE concat('4242-4242 4242', cast(1000 + c_custkey % 9000 AS string)) END AS card,
       concat(cast(c_custkey + 1 AS string), ' Long ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' Street' ELSE ' ave' END,
              ', Town 12345', CASE WHEN c_custkey % 3 = 0 THEN '-6789' ELSE '' END) AS address
FROM {customer}
"""
_C = plain(CONTACTS)


def _contacts(spark, sf_dir):
    return derive(spark, sf_dir, CONTACTS, "customer")


def _digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


@query("mask_email", f"""
SELECT c_custkey, CASE WHEN pos = 0 THEN email ELSE ml || '@' || dom END AS kept,
  CASE WHEN pos = 0 THEN email WHEN position('.' IN dom) > 0
       THEN ml || '@' || repeat('*', position('.' IN dom) - 1) || substr(dom, position('.' IN dom))
       ELSE ml || '@' || repeat('*', length(dom)) END AS hidden
FROM (SELECT *, CASE WHEN length(loc) <= 2 THEN repeat('*', length(loc)) ELSE loc[1] || repeat('*', length(loc) - 2) || loc[-1] END AS ml
      FROM (SELECT c_custkey, email, position('@' IN email) AS pos, split_part(email, '@', 1) AS loc,
                   substr(email, position('@' IN email) + 1) AS dom FROM ({_C})))""")
def mask_email(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", mk.mask_email(F.col("email")).alias("kept"),
                                           mk.mask_email(F.col("email"), preserve_domain=False).alias("hidden"))


@query("mask_phone", f"""
SELECT c_custkey, CASE WHEN length(d) < 4 THEN repeat('*', length(phone)) ELSE
    array_to_string(list_transform(range(1, length(phone) + 1), lambda i: CASE WHEN phone[i] BETWEEN '0' AND '9'
      AND length(regexp_replace(phone[i:], '[^0-9]', '', 'g')) > 4 THEN '*' ELSE phone[i] END), '') END AS formatted,
  CASE WHEN length(d) < 4 THEN repeat('*', length(phone)) ELSE repeat('*', length(d) - 4) || right(d, 4) END AS digits_only
FROM (SELECT c_custkey, phone, {_digits('phone')} AS d FROM ({_C}))""")
def mask_phone(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", mk.mask_phone(F.col("phone")).alias("formatted"),
                                           mk.mask_phone(F.col("phone"), preserve_format=False).alias("digits_only"))


@query("mask_ssn_card", f"""
SELECT c_custkey, CASE WHEN length(s) = 9 THEN '***-**-' || right(s, 4) ELSE repeat('*', length(ssn)) END AS ssn,
  CASE WHEN length(d) < 4 THEN repeat('*', length(card)) ELSE
    rtrim(regexp_replace(repeat('*', length(d) - 4) || right(d, 4), '(.{{4}})', '\\1 ', 'g')) END AS card
FROM (SELECT c_custkey, ssn, card, {_digits('ssn')} AS s, {_digits('card')} AS d FROM ({_C}))""")
def mask_ssn_card(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", mk.mask_ssn(F.col("ssn")).alias("ssn"), mk.mask_credit_card(F.col("card")).alias("card"))


@query("mask_customer_names", """
SELECT c_custkey, left(c_name, 1) || '. [ANONYMIZED]' AS with_initial, '[ANONYMIZED]' AS without_initial FROM customer""")
def mask_customer_names(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(
        "c_custkey", mk.anonymize_name(F.col("c_name")).alias("with_initial"),
        mk.anonymize_name(F.col("c_name"), preserve_initial=False).alias("without_initial"))


@query("mask_addresses", f"""
SELECT c_custkey, r AS hidden, r || ', ' || regexp_extract(address, '\\b\\d{{5}}(-\\d{{4}})?\\b') AS with_zip
FROM (SELECT c_custkey, address, trim(regexp_replace(address,
  '(?i)\\d+\\s+.*?(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)', '[ADDRESS REDACTED]', 'g')) AS r FROM ({_C}))""")
def mask_addresses(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", mk.anonymize_address(F.col("address")).alias("hidden"),
                                           mk.anonymize_address(F.col("address"), preserve_zip=True).alias("with_zip"))


def _hash(c: str, n: int = 16) -> str:
    return f"left(sha256({c} || '{SALT}'), {n})"


@query("token_vault_roundtrip", f"""
SELECT c_custkey, c_mktsegment AS original, {_hash('c_mktsegment')} AS token, c_mktsegment AS restored FROM customer""")
def token_vault_roundtrip(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    vault = anonymise.token_vault(customers, "c_mktsegment", SALT)
    masked = customers.select("c_custkey", F.col("c_mktsegment").alias("original"), mk.hash_value(F.col("c_mktsegment"), SALT).alias("token"))
    return anonymise.detokenize(masked, "token", vault, "restored")


@query("vault_statistics", "SELECT count(DISTINCT c_name) AS total_tokens, count(DISTINCT c_name) AS reversible_tokens FROM customer")
def vault_statistics(spark, sf_dir):
    return anonymise.vault_statistics(anonymise.token_vault(load(spark, sf_dir, "customer"), "c_name", SALT))


@query("hash_anonymize", f"SELECT s_suppkey, {_hash('s_name')} AS short, {_hash('s_name', 40)} AS long FROM supplier")
def hash_anonymize(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", mk.hash_value(F.col("s_name"), SALT).alias("short"),
                                                  mk.hash_value(F.col("s_name"), SALT, 40).alias("long"))


POLICIES = {"c_custkey": "skip", "c_name": "name", "email": "email", "phone": "phone", "ssn": "ssn", "card": "token", "address": "hash"}


@query("batch_anonymize", f"""
SELECT c_custkey, left(c_name, 1) || '. [ANONYMIZED]' AS c_name, {_hash('card')} AS card, {_hash('address')} AS address,
  CASE WHEN length({_digits('ssn')}) = 9 THEN '***-**-' || right({_digits('ssn')}, 4) ELSE repeat('*', length(ssn)) END AS ssn
FROM ({_C})""")
def batch_anonymize(spark, sf_dir):
    return anonymise.batch_anonymize(_contacts(spark, sf_dir), POLICIES, SALT).drop("email", "phone")


@query("anonymisation_report", f"""
SELECT 'c_custkey' AS field, 'skip' AS policy, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_changed,
  CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS original_length, CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS anonymized_length FROM customer
UNION ALL SELECT 'c_name', 'name', count(*), count(*), CAST(sum(length(c_name)) AS BIGINT), CAST(count(*) * 15 AS BIGINT) FROM customer
UNION ALL SELECT 'c_mktsegment', 'token', count(*), count(*), CAST(sum(length(c_mktsegment)) AS BIGINT), CAST(count(*) * 16 AS BIGINT) FROM customer""")
def anonymisation_report(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return anonymise.anonymisation_report(customers, {"c_custkey": "skip", "c_name": "name", "c_mktsegment": "token"}, SALT)


@query("change_kinds", f"""
SELECT 'phone' AS field, CASE WHEN contains(m, '*') AND m <> phone THEN 'partial_mask' ELSE 'none' END AS kind, count(*) AS n
FROM (SELECT phone, CASE WHEN length({_digits('phone')}) < 4 THEN repeat('*', length(phone)) ELSE '*' || phone END AS m FROM ({_C})) GROUP BY ALL
UNION ALL SELECT 'name', 'unknown', count(*) FROM customer
UNION ALL SELECT 'ssn', 'hash', count(*) FROM customer""")
def change_kinds(spark, sf_dir):
    c = _contacts(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), anonymise.change_kind(F.col(col), new).alias("kind")) for f, col, new in [
        ("phone", "phone", mk.mask_phone(F.col("phone"))), ("name", "c_name", mk.anonymize_name(F.col("c_name"))),
        ("ssn", "ssn", mk.hash_value(F.col("ssn"), SALT))]])
    return c.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.kind").agg(F.count("*").alias("n"))


@query("random_tokens", "SELECT count(*) AS tokens, CAST(16 AS INT) AS min_length, CAST(16 AS INT) AS max_length FROM customer")
def random_tokens(spark, sf_dir):
    tokens = load(spark, sf_dir, "customer").select(mk.random_token().alias("t"))
    return tokens.agg(F.countDistinct("t").alias("tokens"), F.min(F.length("t")).alias("min_length"), F.max(F.length("t")).alias("max_length"))


def _replace_all(source: str, kind: str, mask: str) -> str:
    """One pass: replace every distinct match ``m`` by ``mask``, longest first."""
    pattern = mk.FREE_TEXT_PATTERNS[kind].replace("(?U)", "").replace("'", "''")
    found = f"list_sort(list_distinct(regexp_extract_all(text, '{pattern}')), 'DESC')"
    return f"SELECT * REPLACE (list_reduce(list_prepend(text, {found}), lambda acc, m: replace(acc, m, {mask})) AS text) FROM ({source})"


# Messages that carry contact values in every shape of the free-text pass.
CONTACT_MESSAGES = """
SELECT conv_id, turn, role, concat(text, ' mail c', cast(conv_id AS string), '@mail.example.org or ab@x.example.com, call +1 (555) 123-', cast(1000 + turn AS string),
       ' or 555.987.', cast(2000 + conv_id % 1000 AS string), ', id 123-45-', cast(3000 + turn AS string), ', card 4242-4242 4242', cast(4000 + conv_id % 1000 AS string), '.') AS text
FROM {conversations}
"""
_MASKED_TEXT = _replace_all(plain(CONTACT_MESSAGES), "email",
    "CASE WHEN length(split_part(m, '@', 1)) <= 2 THEN repeat('*', length(split_part(m, '@', 1))) ELSE m[1] || repeat('*', length(split_part(m, '@', 1)) - 2) || split_part(m, '@', 1)[-1] END || '@' || split_part(m, '@', 2)")
_MASKED_TEXT = _replace_all(_MASKED_TEXT, "phone",
    "array_to_string(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN m[i] BETWEEN '0' AND '9' AND length(regexp_replace(m[i:], '[^0-9]', '', 'g')) > 4 THEN '*' ELSE m[i] END), '')")
_MASKED_TEXT = _replace_all(_MASKED_TEXT, "ssn", "'***-**-' || right(m, 4)")
_MASKED_TEXT = _replace_all(_MASKED_TEXT, "credit_card", "'**** **** **** ' || right(regexp_replace(m, '[^0-9]', '', 'g'), 4)")


@query("mask_contact_messages", _MASKED_TEXT)
def mask_contact_messages(spark, sf_dir):
    rows = spread(derive(spark, sf_dir, CONTACT_MESSAGES, "conversations"))
    return rows.withColumn("text", mk.anonymize_text(F.col("text")))


@query("mask_conversations", _MASKED_TEXT.replace(plain(CONTACT_MESSAGES), "SELECT * FROM conversations"))
def mask_conversations(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", mk.anonymize_text(F.col("text")).alias("text"))


@query("mask_documents_changed", """
SELECT doc_id, regexp_replace(text, '\\b([A-Za-z0-9._%+-])([A-Za-z0-9._%+-]*)@([A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})\\b', '@\\3', 'g') AS without_local
FROM documents WHERE regexp_matches(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b')""")
def mask_documents_changed(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    masked = docs.select("doc_id", "text", mk.anonymize_text(F.col("text"), ("email",)).alias("masked"))
    return masked.filter(F.col("text") != F.col("masked")).select(
        "doc_id", F.regexp_replace("masked", r"[A-Za-z0-9._%+-]?\*+[A-Za-z0-9._%+-]?@", "@").alias("without_local"))
