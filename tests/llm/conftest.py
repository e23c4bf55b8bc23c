import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TESSERA_MASTER", "local[4]")
    os.environ.setdefault("TESSERA_SHUFFLE_PARTITIONS", "4")
    from tessera.session import get_spark

    return get_spark()


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, long, repeated and awkward texts."""
    long_word = "x" * 30_000
    passage = " ".join(f"word{i}" for i in range(60))
    return [
        None,
        "",
        " \t\n\r\x0b\x0c ",
        "one",
        "One Two three",
        passage,
        passage,
        passage.upper(),
        passage + " and some more of it",
        "before it " + passage,
        long_word,
        ("a line that repeats itself\n" * 50) + "end",
        "  A LINE that repeats itself \t\nother",
        "ünï çödé Éé   wide　space 你好 世界 🎉🎉 \x1c\x85 end",
        "mail a.b@c.de, ip 10.0.0.255 or 10.0.0.256, +49 (30) 1234-5678, 4111 1111 1111 1111.",
        "1" * 5000,
        "aaaa" * 2000 + " \n\n\n  'll don't",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts with ids, a null id, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", None, "clash", 1.5) for i, t in enumerate(odd_texts)]
    rows += [(None, odd_texts[5], None, "s", None, None), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, key string, score double")


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="tessera-test-")
