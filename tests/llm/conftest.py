import pytest

#: Columns with the names that operators add or use inside.
EXTRA = "score string, n_words string, fp string, component_id string, size string, copies string, n_lines string, n_removed string, n_replaced string, sequence_id string, offset string, _key string, _th string, _nth string, row string"
N_EXTRA = len(EXTRA.split(", "))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, source), with clashing extra columns."""

    def of(rows):
        full = [(d, t, "en", s, None if t is None else len(t), *["x"] * N_EXTRA) for d, t, s in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return of


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    return documents([
        (None, None, None), (None, base, "a"), (None, base, "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, base, "b"), (4, base, "b"), (4, base + " rho", "b"),
        (5, long, "a"), (6, base, None), (7, "one", "b"), (8, f"l1 a\nl2 b\nl3 c\n\nl4 d\n{base}", "b"), (9, f"l0\nl1 a\nl2 b\nl3 c\nl5", "a"), (10, "😀 é \x1c x".encode("utf-16", "surrogatepass").decode("utf-16"), "é"),
    ])
