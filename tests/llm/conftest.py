import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, "
          "row int, bucket long, key string, cls long, n long, length long, piece int, "
          "component_id long, text_key long, quality int, part int, kind string, shard int, "
          "_id long, _key long, spans binary, toks string")
EXTRA = (0.5, 1, 2, "k", 3, 4, 5, 6, 7, 8, 1, 2, "x", 3, 4, 5, None, "t")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
                    for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = prose(1, 120)
    near = base.rsplit(" ", 3)[0] + " other ending words"
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, prose(2, 30_000)),
            (7, near), (None, prose(3, 60)), (9, prose(4, 3)), (1, base), (10, "一二三四五六七八"),
            (11, "x" * 5000), (12, "12345 !!! ..."), (13, prose(1, 119)), (None, None), (14, near),
            (1 << 40, base.upper())]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], None if k % 4 == 0 else f"s{k % 2}",
             None if k % 5 == 0 else len(t or ""), *EXTRA) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with extra columns whose names operators might use."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
