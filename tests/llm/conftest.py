import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, bucket int, size string, mark string"


def passage(rng, words, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty, blank and long texts, copies, near copies, repeated rows, other scripts, clashing column names."""
    rng = random.Random(5)
    base = passage(rng, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    texts = [
        None, "", " \t\n", "one", "ONE", "one two", base, base, base.replace(" ", "\n", 7), base.upper(), near, base + " " + base,
        "é" * 900, "日本語 テキスト " * 120, "a" * 2000, "ab" * 700, passage(rng, 20_000), "x y   z\x0b\x1c.", "▁ ▁a b",
        "!!! ??? ...", "\x00\x01 zero", "<s> </s> <unk>",
    ] + [passage(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(i * 7 % 60 + 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s10", None, "Z"]), i, "w", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "s1", 1, "w", None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
