import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, label int, size long, fp long, _id string"
LABELS = "doc_id long, quality int, toxic int, text string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, repeated rows and texts, and columns whose names clash."""
    rng = random.Random(7)
    common = [a + b for a in ("the", "of", "ing", "er") for b in ("on", "an", "re", "st", "")]
    out = []
    for i in range(160):
        text = words(rng, rng.randrange(1, 90), common)
        if i % 9 == 0:
            text += " idiot loser trash idiot"
        if i % 11 == 0:
            text = "NOW!! BUY!! " * 30
        lang, text = ("en", text) if i % 2 else ("de", text.replace("th", "sch").replace("o", "ö"))
        out.append((i, text, lang, f"src{i % 5}", len(text)))
    out += [
        (200, None, "en", "src0", None), (201, "", None, None, 0), (202, " \t\n ", "en", "src1", 4), (203, None, None, None, None),
        (204, words(rng, 60_000, common), "en", "src0", 1), (205, "one", "en", "Src0", 3), (206, "ONE  two", "en", "ü", 8),
        (206, "ONE  two", "en", "ü", 8), (None, "no id at all here", "en", "src2", 5), (None, "no id at all here", "en", "src2", 5),
        (207, 'token = "0123456789abcdef0123456789abcdef" ▁ 日本\x00', "en", "src3", 9), (208, "one", "en", "src4", 3),
    ]
    out += [(300 + i, out[5][1], "en", "src0", 1) for i in range(40)]  # a group of copies
    return [(*r, 1, 2, 3, 4, "x") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(r[0], int("!!" not in (r[1] or "")), int("trash" in (r[1] or "")), "clash") for r in rows if r[0] is not None and r[0] < 160]
    return spark.createDataFrame([*known, (5, None, None, None), (None, 1, 1, None), (99999, 1, 1, None)], LABELS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="session")
def sf(tmp_path_factory, docs, labels):
    """A directory laid out like the test data."""
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float(i % 7), float(i % 5), 1.0], 1, 2, 3.0) for i in range(120)] + [(100, [1.0], 1, 2, 3.0), (None, [1.0], 1, 2, 3.0), (150, None, 1, 2, 3.0), (200, [None, 1.0], 1, 2, 3.0), (250, [], 1, 2, 3.0)]
    docs.sparkSession.createDataFrame(vectors, "vec_id long, embedding array<double>, id long, rank int, score double").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_sf(tmp_path_factory, empty, no_labels):
    path = tmp_path_factory.mktemp("empty")
    empty.write.parquet(f"{path}/documents.parquet")
    no_labels.write.parquet(f"{path}/labels.parquet")
    empty.sparkSession.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)
