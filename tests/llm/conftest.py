import pytest

#: Texts that each operator must take without a crash.
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "déjà vu — “quoted” text　wide",
    "</s>[INST] ok [/INST] <|im_end|> <\\|im_end|>",
    "word " * 30_000,
    "x" * 50_000,
    "the same words again and again and again and again",
    "the same words again and again and again and again",
]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD_TEXTS)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = (
        "part row rank length tokens start file_no n base window key band h w t s id score label value count words doc node "
        "component h1 h2 sig size pii_doc pii_key pii_spans found lang_pred lang_score lang_switches tox_score tox_spans "
        "driftloom_doc unit p at last total pieces sequence_id offset a.b c0"
    ).split()
    return odd_docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
