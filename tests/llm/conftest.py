"""Small tables with every awkward case."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    """(doc_id, text, lang, source, n_chars, and columns named like results)."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "Two words",
        base,
        base,
        " ".join(near),
        base.upper(),
        "Ünïcödé ß ñ 漢字 🙂 é   no break\x1cspace",
        "12 34 !!! ###",
        "\n".join(["same line of text here"] * 5),
        prose(rng, 20_000),
        "the " * 400,
        "a" * 5_000,
    ]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["a", "b", None][i % 3], len(t or ""), "x", False, 1.5) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, base, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    rows.append((7, "another text under a used id", "en", "a", 1, "x", True, 0.0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept boolean, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **columns):
        rows = [(i, t, None, None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)

    return make
