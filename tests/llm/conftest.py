import random

import pytest

DATA = "/root/testdata/sf0.001"

ODD = [
    None,
    "",
    " ",
    "\n\n \t",
    "a",
    "It's 42 o'clock; we'll go <|endoftext|> now<|startoftext|>x",
    "tab\there  two   spaces\r\nline\x0b\x0cend ",
    "a b   c \n d　  e\x85 f",
    "Straße İstanbul ΣΟΦΟΣ café \U0001f600\U0001f468‍\U0001f469 你好",
    "\x00\x01\x1c\x1f\x7f",
    "a" * 5000,
    "the cat sat on the mat and the dog ran away " * 300,
    "one two three\none two three\n\n\none two three \n",
]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    alphabet = "abcdeABC 019.,;!'\n\téß 你#*"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(120)] + ["shared text of ten words that comes more than once here"] * 3


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd and random texts, with a null id, repeated rows, and a column whose name the operators use themselves."""
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(None, "no id at all", None, None), (3, texts[3], "x", 3), (20, texts[20], "x", 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")
