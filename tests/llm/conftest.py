import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} tail{i}." for i in range(30_000))
    article = "It was the best of times and it was the worst of times. The house of the family is on the hill by the sea. All of them are there now and they will stay for the winter. No one knows what they want from us."
    rows = [
        (1, article + " Released under the MIT License.", "a", "en", 1), (2, article + " Released under the MIT License.", "a", "en", 1), (3, article + " Released under the MIT license now.", "b", "en", 1),
        (4, None, "a", None, None), (5, "", None, "en", 0), (6, long, "b", "en", 5), (7, "one", "b", "en", 3), (8, "one", "b", "en", 3), (8, "one", "b", "en", 3), (None, "no id here", "c", "en", 3), (9, " \t\n ", "a", "en", 4),
        (10, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nGNU General Public License", "a", "en", 9),
    ]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, kept int, score string, sketch string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
