import pytest

EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one", "en", None),
    (5, "two words", None, "b"), (6, "Same text here now", "en", "b"), (6, "Same text here now", "en", "b"),
    (None, "Same text here now", "en", "b"), (7, "é ü Ünder THE mit LICENSE under the MIT license", "de", "c"),
    (8, 'password = "abc12" token: secret: token: abcdefgh AKIA' + "Q" * 16 + " " + "0a" * 12, "en", "c"),
    (9, "word " * 50_000 + "end\n" * 3, "en", "c"), (10, "x" * 300_000, "en", "c"),
    (11, "Ä" * 40 + ' api_key="q1w2e3" \U0001F600 passwd:abcdef ' + "f" * 23, "de", "a"),
    (12, "cc by nc cc-by-nc-sa, CC BY NC", "en", "a"), (13, "apache license, version 2 <|endoftext|> x", "en", "a"),
    (14, "a b c d e f a b c d e g a b c d e", "en", "a"), (15, "l\nl\n l\nl \n\nl", "en", "a"),
]


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, key string, size long, h string, row int, x0 double"
    return spark.createDataFrame([(*r, "k", 1, None, 2, 0.5) for r in EDGE], schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """Write tables to a folder that the registered queries can read."""
    def build(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)
    return build
