"""Small tables that hold every awkward case at once."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns; here they are columns of the input.
CLASH = ", size long, key string, shard int, taken double, node long, _h int, score string, _part int, __source string, digest string, uid int"


def words(rng: random.Random, n: int) -> str:
    kinds = "the of and river stone green walks under light house paper cloud seven small ground before every number".split()
    return " ".join(rng.choice(kinds) + rng.choice(["", "", "ing", "ed", "s"]) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 120)
    texts = {
        1: base, 2: base, 3: None, 4: "", 5: " \t\n", 6: "one", 7: "one two three", 8: "Émile naïve 🙂 ñ\u0000x " + words(rng, 40), 9: words(rng, 30_000),
        10: base + " extra tail", 11: base.upper(), 12: "a" * 5000, 13: "ab" * 700, 14: words(rng, 60), 15: base[:300] + words(rng, 30), 16: "x y z " + words(rng, 12),
        17: "<|endoftext|> and more", 18: words(rng, 200),
    }
    sources = ["b", "a", None, "é", "a"]
    rows = [(i, t, "en" if i % 3 else None, sources[i % 5], len(t) if t else None) for i, t in texts.items()]
    rows += [rows[0], rows[8], (None, base, "en", "a", 1), (None, None, None, None, None), (14, "another text under the same id " + words(rng, 20), "de", "b", 3)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a shared id, extra columns with clashing names."""
    clash = (1, "k", 2, 0.5, 7, 1, "s", 3, "src", "d", 9)
    return spark.createDataFrame([r + clash for r in awkward_rows()], DOCS + CLASH).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of():
    return awkward_rows()
