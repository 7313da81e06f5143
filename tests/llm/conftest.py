import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

SYLLABLES = {
    "en": "the ing er on re st ed an th or ti es".split(),
    "fr": "le eau ou è que ment tion é re au ais".split(),
}


def prose(rng, lang, n):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def corpus():
    """Sixty documents in two languages, with copies, junk and every awkward case."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        rows.append((i, prose(rng, lang, 70 + i), lang, f"src{i % 4}", 0))
    rows.append((100, rows[5][1], "en", "src0", 0))  # exact copy
    near = rows[7][1].split(" ")
    near[40] = "changed"
    rows.append((101, " ".join(near), "en", "src1", 0))  # near copy
    rows += [
        (102, None, None, None, None),
        (103, "", "en", "src1", 0),
        (104, " \t\n ", "en", None, 0),
        (105, "one two", "en", "src2", 0),
        (106, "one two", "en", "src2", 0),
        (None, "null id here", "en", "src2", 0),
        (107, "x" * 50_000, "en", "src3", 0),
        (108, "a  b \n c<|endoftext|> 日本語 \U0001f600 ▁é  ", "en", "src3", 0),
        (109, rows[1][1] + "\n" + "word " * 3000, "en", "src3", 0),
        (110, "\n".join(["SHOUT!! THE!! OTHER!! LINE!!"] * 30), "en", "src3", 0),
        (3, rows[3][1], "fr", "src3", 0),  # a repeated row
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same rows with further columns that clash with names used inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({
        name: F.lit(1)
        for name in ("id", "row", "bucket", "place", "key", "size", "quality", "class", "draw",
                     "score", "lang_pred", "word", "n", "component", "fingerprint", "copies",
                     "_gone", "_language", "_quality", "_score", "_lang_pred", "fold", "toxic")
    })


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(40)] + [(110, 0, 0), (109, 0, None), (105, None, 3)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def sp_model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
