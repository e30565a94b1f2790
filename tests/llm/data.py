"""Rows that every operator has to bear."""

from __future__ import annotations

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, digest STRING, fp INT, told STRING, score STRING, kept INT, row_no STRING, key STRING, p STRING, value DOUBLE, __score STRING, __told INT, __row_file STRING, __row_index STRING, ROOT MAP<STRING,INT>"
LONG = " ".join(f"word{k % 977} and" for k in range(20_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, None),
    (3, ""),
    (4, " \t\r\n\x0b\x0c"),
    (None, "a text whose id is null, with some words"),
    (None, None),
    (5, "the quick  brown fox jumps over the lazy dog"),
    (6, "the quick brown fox jumps over the lazy dog"),
    (6, "the quick brown fox jumps over the lazy dog"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "äöü ß 日本語 <|endoftext|> 12 ½ \x1c "),
    (10, "x" * 5000),
]


def edges(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", None, "d", 1, "t", "s", 0, "r", "k", "p", float("nan"), "x", 1, "f", "0", {"a": 1}) for i, t in TEXTS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
