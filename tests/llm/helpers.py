"""Small inputs with the awkward cases, and plain versions of the contracts' rules."""

import re

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("text_key", "n_words", "words", "line", "lines", "host", "kind", "row", "label", "key", "start", "one")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, rows):
    """rows: (doc_id, text); with the other columns of documents and columns whose names operators use inside."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHES])
    return spark.createDataFrame(
        [(i, t, "en", None if i == 7 else "src0", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows], schema)


def sentence(*numbers):
    return " ".join(f"word{n}" for n in numbers)


LONG = sentence(*range(3, 60_000))

#: Nulls, empty and blank texts, a very long one, ties, repeated rows, astral and accented letters.
EDGE = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, LONG), (5, sentence(*range(40))), (5, sentence(*range(40))),
    (6, sentence(*range(40))), (7, "É\U0001F600 Àb\n" + sentence(*range(100, 130))), (None, sentence(*range(200, 240))),
    (None, None), (8, "a b c d e a b c d e\na b c d e\na b c d e\n#*$%&|<> x"), (9, "one two"), (10, "ONE two"),
    (11, sentence(*range(40)) + "\n" + sentence(*range(300, 340))),
]
