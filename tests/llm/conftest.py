from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
_DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(30_000))

#: Nulls in every column, empty, blank and very long texts, ties, and repeated rows.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "Released under the MIT License. Licensed under the Apache License, Version 2.0; CC BY-NC 4.0", "en", "c", 90),
    (5, "Released under the MIT License. Licensed under the Apache License, Version 2.0; CC BY-NC 4.0", "en", "c", 90),
    (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", None, 3),
    (None, "no id here but words enough", "fr", "c", 27),
    (None, None, None, None, None),
    (7, "ünïcödé çéè 漢字 😀 under the mit license under the mit license", "de", "ü", 60),
    (8, "line one is here\nline one is here\n\nLine  One is here\n" * 9, "en", "b", 400),
    (9, "don't you're 'tis !'s <|endoftext|>  12a\n\n x", "en", "b", 40),
    (10, "a", "es", "a", 1),
]


def table(spark: SparkSession, rows: list[tuple], schema: str = _DOCS) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return table(spark, ODD).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark: SparkSession) -> DataFrame:
    return table(spark, [])


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df: DataFrame) -> DataFrame:
    """With more columns, named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("_salt", "_nth", "length", "words", "score", "fp", "host", "label", "size", "n", "copies", "_doc", "sequence_id", "lines")
    return df.withColumns({c: F.lit(c) for c in names if c not in df.columns})


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
