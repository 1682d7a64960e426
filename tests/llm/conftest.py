import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    from outlast.llm.settings import configure

    return configure(spark)


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


CLASHES = "block int, kind int, label string, term string, score double, bucket int, signature string, `row` int, place int"


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source, n_chars: nulls, blanks, repeats, ties, a long text."""
    long = " ".join(f"word{i % 997} und" for i in range(30_000))
    texts = [(1, "The cat sat on the mat, and the cat slept."), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (6, "one"),
             (7, "The cat sat on the mat, and the cat slept."), (7, "The cat sat on the mat, and the cat slept."),
             (None, "No id but words."), (None, None), (8, long), (9, "Ärger über Öl ▁ \x00 🙂 ﬁ"), (10, "12 34 !!"),
             (11, "<|endoftext|> Don't stop.")]
    return [(i, t, None if i in (2, 5) else "en", None, None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def odd_documents(llm, odd_rows):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
    rows = [(*r, 1, 2, "x", "y", 0.5, 3, "z", 4, 5) for r in odd_rows]
    return llm.createDataFrame(rows, schema).repartition(2, "n_chars").cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
