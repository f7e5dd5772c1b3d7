import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, h binary, bands int, word string, `_row` int, kept string, sid int, host string"


def prose(seed, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words))


def rows():
    """Texts of every odd kind, with repeated rows, null ids, null sources and columns whose names clash."""
    long = " ".join(prose(k, 400) for k in range(20))
    texts = [
        None,
        "",
        "   \t\n ",
        "one",
        "one two three four",
        prose(1),
        prose(1),
        prose(1) + " extra",
        prose(2),
        "x" * 5000,
        long,
        long.replace(" ", "  ", 3),
        "a b c d e f g h " * 12,
        "line one is here\nline one is here\nother\n\n \n",
        "<|endoftext|> in the middle <|endoftext|>",
        "日本語 テキスト 😀 é  nbsp \x1c sep",
        "A" * 30 + " !!! ### $$$ " + "b" * 600,
    ]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    out += [(5, prose(1), "en", "s2", 0)] * 3 + [(None, prose(3), "en", "s1", 0), (None, None, None, None, None), (2**62, prose(4), "en", "s0", 0), (-7, prose(1), "de", "s0", 0)]
    return [(*r, 1, "x", b"x", 2, "w", 3, "k", 4, "q") for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
