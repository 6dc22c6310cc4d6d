"""Rows that every operator on documents must take."""

from __future__ import annotations

LONG = "word " * 40_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "fr"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.", None),
    (6, "12345 !!! ???", "en"),
    (7, LONG, "en"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (8, "É è ß 日本語 😀\u0000\u001f" + "x" * 5000, None),
    (1, "Another text for an identifier that repeats.", "en"),
    (9, "One", "en"),
    (9, "One", "en"),
]
#: Extra columns named like those that operators make or use.
SCHEMA = "doc_id long, text string, lang string, score double, n_tokens string, KEY int, sig string, pii string, items string, `a b` string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0.5, "t", 1, "s", "p", "i", "z") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})
