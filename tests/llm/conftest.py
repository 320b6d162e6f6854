import pytest

LINES = ["one common line here", "two common line here", "three common line here", "four common line here"]
#: Column names that operators use inside, given to the odd documents as columns of their own.
CLASHING = (
    "_bad _extra _leaky row whole kept base_failed ws n_words n_symbols metric f_lang l lm size shard slot grp best h1 h2 "
    "fingerprint component_id item_id at w ws_hash hash first_doc first_at sequence_id ids text_crc32 part"
).split()
LONG = "the quick brown fox jumps over the lazy dog again " * 400


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, other texts of one doc_id."""
    block = "\n".join(LINES)
    return [
        (1, block + "\nfirst tail of its own", "en", "s"),
        (2, "head of its own\n" + block, "en", "s"),
        (3, None, "en", "s"),
        (4, "", "en", None),
        (5, " \t\n ", None, None),
        (6, LONG, "en", "s"),
        (7, LONG + "end", "en", "s"),
        (8, block, "en", "s"),
        (8, block, "en", "s"),
        (8, "another text of one doc_id\n" + block, "en", "s"),
        (None, "a row without id " + block, "en", "s"),
        (None, None, None, None),
        (9, "x", "de", "t"),
        (10, "A b C", "de", "t"),
        (11, "a B c", "de", "t"),
        (12, "naïve café\x85déjà vu Σσς ǆ " * 9, "fr", "t"),
        (13, "double  blanks \n and\ttabs\r\n\n\n  end ", "fr", "t"),
        (14, "<|endoftext|> <|startoftext|> it's 'll don't 12 34.5 !!", "fr", "t"),
        (-5, "negative id " + block, "fr", "t"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as documents with extra columns of clashing names."""
    rows = [(*r, 7, "x", 1, "k", *(["own"] * len(CLASHING))) for r in odd_rows]
    own = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, key string, v int, block string, {own}"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    return docs


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
