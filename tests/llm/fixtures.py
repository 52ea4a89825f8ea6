"""Small document tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns, as extra columns of the input.
CLASHING = ("n_lines", "n_dropped", "size", "taken", "target", "kept", "n_words", "score", "ids", "name", "key", "copies")


def awkward(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "dÉlta", "mit", "license", "x", "###", "the", "zeta", "ünter", "日本語"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", None]), len(text)))
    long = " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(30_000))
    rows += [(100, long, "en", "a", None), (101, long + " end", "en", "a", None)]
    rows += [(110, None, None, None, None), (111, "", "en", "a", 0), (112, " \t\n\x0b\x0c\r \n", "en", "b", 9), (113, "x" * 50_000, "de", "b", 1)]
    rows += [(120, "same row", "en", "a", 8)] * 3 + [(None, "no id", "en", "a", 5), (None, None, None, None, None)]
    rows += [(130, "THE line\nthe LINE \n\tthe line", None, "b", 1), (131, "emoji 🙂\x85  wide　space\x1c", "de", None, 2)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS).repartition(3)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("other") for c in CLASHING})
