"""Awkward document tables shared by the operator tests."""

from __future__ import annotations

LONG = "lorem ipsum " * 60_000

ROWS = [
    (1, "A quiet house by the river was sold in the spring.", "en", "a", 10, "x", 1.5),
    (2, None, "en", "a", None, "x", None),
    (3, "", None, "b", 0, None, 2.5),
    (4, " \t\n ", "en", None, 5, "y", 0.0),
    (5, LONG, "la", "b", len(LONG), "z", 1.0),
    (6, "A quiet house by the river was sold in the spring.", "en", "c", 10, "x", 1.5),
    (6, "A quiet house by the river was sold in the spring.", "en", "c", 10, "x", 1.5),
    (None, "Le chat noir dort sur la table de la cuisine.", "fr", "c", 3, "q", None),
    (8, "12345 67890 !!", "en", "c", 3, "q", None),
    (9, "<|endoftext|> naïve – 中文 \x1c token x", "en", "c", 3, "q", None),
    (10, "Die alte Stadt liegt am Fluss und die Kinder spielen dort.", "de", "c", 3, "q", None),
]
#: Extra columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size double"


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
