import pytest

from feedlake.session import ensure_checkpoint_dir, ship_package

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tricky() -> list[tuple]:
    """Null and empty texts, odd white space, special strings, ties, repeats and long words."""
    long_text = " ".join(f"word{i % 97} and{i % 13}" for i in range(3000))
    shared = " ".join(f"passage{i}" for i in range(40))
    texts = [
        None,
        "",
        " ",
        "one",
        "a  b\t c\n\n d ",
        "<|endoftext|>x <|endoftext|> y<|endoftext|>",
        "don't WE'RE it's 12 34x é ü ß   x́ 日本語 😀",
        long_text,
        long_text + " end",
        "start " + shared + " tail one",
        "other words first " + shared,
        shared,
        shared,
        "x" * 3000,
        "ab " * 200,
        "Same line\nSame line\nother\nSame line",
        "#*$%&|<> !! ?? " * 20,
        "\x1c \x1d a\x85b",
    ]
    return [(i * 3, t, "en", None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def shipped(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs(shipped):
    return shipped.createDataFrame(tricky(), SCHEMA)


@pytest.fixture(scope="session")
def real(shipped):
    return shipped.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def empty(shipped):
    return shipped.createDataFrame([], SCHEMA)


def texts_of(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
