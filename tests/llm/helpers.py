"""Documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SHARED = "This very sentence stands in many documents at once."
ROWS = [
    (1, f"Alpha beta gamma delta epsilon zeta eta theta.\n{SHARED}\nend one", "en", "a", 10, "x", 1),
    (2, f"Alpha beta gamma delta epsilon zeta eta iota.\n  {SHARED.upper()} \nend two", "en", "a", 10, "x", 2),
    (3, f"{SHARED}\n{SHARED}\n\nother words here", "fr", "b", 10, None, 3),
    (3, f"{SHARED}\n{SHARED}\n\nother words here", "fr", "b", 10, None, 3),
    (4, None, "de", None, None, "x", 4),
    (5, "", None, "c", 0, "x", 5),
    (6, LONG, "en", "a", len(LONG), "x", 6),
    (None, "no id but a text of some words", "en", "b", 30, "x", 7),
    (7, "été ▁ naïve 日本語 \u0000 \\ <|im_end|>", "fr", None, 5, "x", 8),
    (8, "one", "en", "a", 3, "x", 9),
    (9, "one", "en", "a", 3, "x", 9),
    (10, " \t\n ", "en", "b", 4, "x", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int"


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
