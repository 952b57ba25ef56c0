import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(["the", "of", "and", "river", "stone", "Über", "naïve", "light", "it's", "42"]) + rnd.choice(["", "", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with all that a table may hold: nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (3, 4, 5, 6, 30, 80, 200, 400)]
    texts += [texts[5], texts[5] + " one more", texts[6].upper(), "", None, "   \n\t ", "x", "word " * 3000, "a" * 20_000, "\x1c odd   ́ white", "ÄÖÜ ß \U0001f600 emoji"]
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, texts[3], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def table_dir(path, spark, **tables) -> str:
    """Writes tables as ``<name>.parquet`` in a folder and returns it."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
