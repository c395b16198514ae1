"""Small document tables with the cases that every operator has to handle."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties and repeated rows."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(1, 120))) + "." for _ in range(40)]
    rows = [(k, t, "en" if k % 3 else "de", f"src{k % 4}", len(t)) for k, t in enumerate(prose)]
    rows += [(100 + k, prose[k % 3], "en", "src0", len(prose[k % 3])) for k in range(12)]  # copies
    rows += [(200 + k, prose[5] + f" extra{k}", "en", "src1", None) for k in range(3)]  # near copies
    rows += [
        (300, None, "en", "src0", None),
        (301, "", "en", "src1", 0),
        (302, " \t\n ", None, None, 4),
        (303, "x" * 30_000, "en", "src2", 30_000),
        (304, ("lorem ipsum dolor " * 3000).strip(), None, "src2", None),
        (305, "12345 --- 67", "en", None, 12),
        (306, "one", "de", "src3", 3),
        (307, "one", "de", "src3", 3),
        (308, 'user: bob password=abcdef token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "src1", 75),
        (309, "Released under the MIT License.\n" + prose[9], "en", "src1", None),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark, documents):
    """Also rows with null or repeated doc_ids, and further columns with names that operators use inside."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(None, "no id here at all", "en", "src0", 17), (1, "another text of document one", "en", "src9", 28), (306, "one", "de", "src3", 3)], SCHEMA)
    rows = documents.unionByName(more)
    for name in ("fp", "key", "uid", "block", "size", "score", "position", "pass", "start", "hash", "k", "file", "path", "row", "base", "weak", "__base", "__weak", "__added", "__key", "__text", "__size", "__pass", "__position", "__source_size", "rejected_language", "ids"):
        rows = rows.withColumn(name, F.lit(f"clash {name}"))
    return rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
