import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from raterlab.session import local_session
    yield local_session(cores=4, shuffle_partitions=4, app="raterlab-tests")


#: nulls, empty and blank texts, a long one, repeated rows, ties and columns named like results
ROWS = [(1, "Alpha beta gamma delta epsilon zeta", "a", 7), (2, "ALPHA beta gamma delta epsilon zeta", "a", 7),
        (3, None, None, 7), (4, "", "b", 7), (5, " \t", "b", 7), (6, "one two", "b", 7), (6, "one two", "b", 7),
        (7, "long " * 30_000 + "end", "c", 7), (None, "no id here", "c", 7), (8, "é É <|endoftext|> 's 123 \u2028x", "a", 7)]
SCHEMA = "doc_id long, text string, source string, size int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
