"""A table with what real tables hold: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest

WORDS = "the of and sun moon star river stone cloud light wind rain tree leaf branch root seed fruit bird fish wolf bear".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "s", "'s", "’t"]) for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    shared, other = prose(rng, 60), prose(rng, 45)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    rows += [(100, None), (101, None), (102, ""), (103, " \n\t "), (104, "!!!"), (None, prose(rng, 30)), (None, None), (None, shared)]
    rows += [(110, shared), (111, shared + "  "), (112, shared.replace(" ", "\n")), (110, shared), (110, shared)]
    rows += [(120, prose(rng, 20) + shared + prose(rng, 20)), (121, other + shared), (122, other * 3), (123, "ab" * 400), (124, "é中" * 300)]
    rows += [(130, prose(rng, 6000)), (131, "<|endoftext|>x<|endoftext|> á İSTANBUL ΣΑΣ don't we'll 12 345\x00\x1c  end  ")]
    rows += [(140 + i, "token = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + f" and AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOP234567') for _ in range(16))} x") for i in range(6)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns whose names clash with each other and with those that operators make."""
    from pyspark.sql import functions as F

    names = ["id", "row", "text_", "fp", "h", "norm", "chunks", "n_tokens", "spans", "key", "score", "kept"]
    return docs.select("doc_id", "text", *(F.lit(None).cast("string").alias(n) for n in names), F.lit("x").alias("Text"), F.lit("y").alias("DOC_ID"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(frame, *columns):
    """Rows as sorted tuples; nulls sort first."""
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
