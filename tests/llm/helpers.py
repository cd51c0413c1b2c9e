"""Small fixtures and plain reference versions for the tests."""

import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, "   ", "en", "a", 3), (4, "one", "en", None, 3),
    (4, "one", "en", None, 3), (5, "ONE", "de", "b", 3), (6, "one two", "de", "b", 7), (None, "one two", None, "b", 7),
    (7, "wörd " * 30000, "fr", "c", 150000), (8, "a b c d e f g h i j", "es", "c", 19),
]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOC)
    if extra:  # columns whose names the operators also use inside
        for name in ("v", "n", "c", "block", "score", "size", "shingles", "shard", "part", "key", "role", "item_id", "toxic"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def split(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
