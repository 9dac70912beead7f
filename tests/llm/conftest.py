import pytest

from tremorlens.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, source="a"):
    return [(i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of the texts, ids from 0, over several partitions."""

    def build(texts, source="a", partitions=3):
        return spark.createDataFrame(rows_of(texts, source), SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def clashing():
    """The table with columns whose names operators use inside, and with repeated rows and a null id."""

    def build(docs):
        names = "id t row k run digest score spans fingerprint part queue base line chunk bucket words ids n before".split()
        wide = docs.selectExpr("*", *(f"'x' AS `{c}`" for c in names))
        return wide.union(wide).union(wide.selectExpr("CAST(NULL AS BIGINT) AS doc_id", *wide.columns[1:]).limit(1))

    return build


@pytest.fixture(scope="session")
def json_path():
    return tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def rank_path():
    return tokenizer("byte_bpe_50k.tiktoken")


TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "It's we'll they're I've I'm he'd 'tis ''s x's don't",
    "  leading, trailing  ",
    "a" * 5000 + " " + "%*$" * 900 + " " * 300 + "x",
    "éß漢字 \U0001f600٣½ 　 x\x1c\x85y",
    "one <|endoftext|> two<|endoftext|>",
    "'" * 40 + "s",
    "one <|endoftext|> two<|endoftext|>",
    "password = \"hunter2hunter2\" and token: abc then SECRET:zzzzzzzz",
    "word " * 20000,
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS
