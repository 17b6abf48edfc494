import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LEXICON = {
    "en": "the house river stone walks under bright morning garden people music because water table singing".split(),
    "de": "der straße fluss über schöner garten menschen weil wasser tisch singend größer himmel nicht".split(),
    "fr": "les maisons rivière pierre marche lumière jardin peuple parce que eau chanter école très".split(),
}


def make_docs(n=60, seed=1):
    """Documents of every awkward kind: null and blank texts, copies, repeated rows, one long text, null columns."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(LEXICON))
        words = [r.choice(LEXICON[lang]) + (r.choice(["", "", "s", ".", ","])) for _ in range(r.randint(3, 80))]
        rows.append((i, " ".join(words), lang, f"src{i % 4}", None))
    long = " ".join(r.choice(LEXICON["en"]) for _ in range(30_000))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \t\n", None, "src1", 3), (n + 3, long, "en", "src0", len(long)), (n + 4, rows[3][1], rows[3][2], "src9", None)]
    rows += [rows[5], (None, "no id here at all", "en", "src2", 17), (n + 5, "12 34 !! ??", None, "src2", 11), (n + 6, "émile@x.fr ﷽ 😀 a@b.co", "fr", "src3", 23)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide_docs(docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("fp", "key", "size", "score", "lang_pred", "sid", "ids", "target", "component", "_id")})
