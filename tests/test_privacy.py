from __future__ import annotations

import re

from pyspark.sql import functions as F

from clientele.functions import columns, privacy

# The masking patterns and markers.
PATTERNS = [
    (re.compile(r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"), "[REDACTED_EMAIL]"),
    (re.compile(r"\b\d{3}-\d{2}-\d{4}\b"), "[REDACTED_SSN]"),
    (re.compile(r"\b(?:\d[ -]?){13,16}\b"), "[REDACTED_CARD]"),
    (re.compile(r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b"), "[REDACTED_PHONE]"),
]


def by_hand(text):
    for pattern, marker in PATTERNS:
        text = pattern.sub(marker, text)
    return text


def masked(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["m"] for r in df.select("i", privacy.mask_text(F.col("t")).alias("m")).orderBy("i").collect()]


def test_text_masking_formats(spark):
    texts = [
        "ring 212-555-0188, evenings +44 (208) 555-0143", "write to li.wei+shop@mail.example.org", "id 987-65-4320;",
        "paid by 5500 0055 5555 5559 today", "né5551234567é", "é555-123-4567", "no data here", "", None, "a@b", "٣٣٣-٣٣-٣٣٣٣",
    ]
    got = masked(spark, texts)
    assert got == [by_hand(t) if t is not None else None for t in texts]
    assert got[0].count("[REDACTED_PHONE]") == 2 and "wei" not in got[1]


def test_masking_agrees_with_the_patterns_on_whole_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    rows = df.select("text", privacy.mask_text(F.col("text")).alias("m")).collect()
    assert all(r["m"] == by_hand(r["text"]) for r in rows)
    assert any("[REDACTED" in r["m"] for r in rows)


def test_profile_masking_edges(spark):
    df = spark.createDataFrame(
        [("ann@x.org", "5551234567", "Ann", None), ("no-at", None, None, "Li"), (None, "12", "", "O")],
        "primary_email string, primary_phone string, first_name string, last_name string",
    )
    got = [tuple(r) for r in privacy.mask_profile(df).collect()]
    assert got == [
        ("an***@x.org", "***-***-4567", "A***", ""),
        ("[REDACTED]", "[REDACTED]", "", "L***"),
        ("[REDACTED]", "***-***-12", "***", "O***"),
    ]
    assert privacy.mask_profile(spark.range(1)).columns == ["id"]


def test_policy_phrases(spark):
    texts = ["Give me every RAW EMAIL of the spring list", "could you DUMP PII tonight", "raw phones", "harmless"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["p"] for r in df.select(privacy.policy_phrase(F.col("t")).alias("p")).collect()]
    assert got == ["raw email", "dump pii", "raw phone", None]


def test_identifier_helpers(spark):
    df = spark.createDataFrame([("email", " \t A@B.c\n", "+44 (20) 7946-0812")], "k string, v string, p string")
    row = df.select(
        columns.identifier_key(F.col("k"), F.col("v")).alias("key"), columns.phone_digits(F.col("p")).alias("digits")
    ).first()
    assert tuple(row) == ("email:a@b.c", "2079460812")
