"""Awkward rows, and runs of an operator over them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASHING = ("id", "key", "h", "fp", "d", "row", "u", "size", "score", "part", "tail", "length", "piece", "copies", "label", "y", "times", "copy", "keep_id", "_row", "_rank", "bin", "q", "s")

VOWELS, CONSONANTS = "aeiou", "bcdfglmnprst"


def word(r: random.Random) -> str:
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randint(1, 4)))


def prose(r: random.Random, n: int) -> str:
    return "".join(word(r) + r.choice((" ", " ", " ", " ", ", ", ".\n", "\t", "  ")) for _ in range(n))


def awkward(seed: int = 0, plain: int = 60) -> list[tuple]:
    """Nulls in every column, empty, blank, long and repeated texts, ties and repeated rows, several scripts."""
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(1, 120)), r.choice(("xx", "yy")), r.choice(("a", "b", "é", None)), 1) for i in range(plain)]
    rows += [
        (100, None, "xx", "a", None),
        (101, "", "xx", "a", 0),
        (102, " \t\n ", None, None, 4),
        (None, "null id and a text", "yy", "b", 18),
        (None, "null id and a text", "yy", "b", 18),
        (None, None, None, None, None),
        (103, rows[0][1], "xx", "b", 1),
        (103, rows[0][1], "xx", "b", 1),
        (104, rows[1][1] + " altered", "xx", "a", 1),
        (104, "same id, other text", "xx", "a", 1),
        (105, "x" * 200_000, "xx", "a", 1),
        (106, prose(r, 40_000), "yy", "b", 1),
        (107, "中文字符没有空格" * 20, None, "b", 1),
        (108, "é́ İstanbul ǅ ß 😀 ​­ 12 ½", "yy", "a", 1),
        (109, "<|endoftext|> \x00\x1c\x85 a", "yy", "a", 1),
        (-7, "12345 67890 !!", "xx", "", 1),
    ]
    return rows


def frame(spark, rows=None, schema=DOCS, partitions=3):
    return spark.createDataFrame(awkward() if rows is None else rows, schema).repartition(partitions)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING) if c not in df.columns})


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def save(df, folder, name) -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
