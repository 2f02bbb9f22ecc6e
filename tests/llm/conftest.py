import random

import pytest

WORDS = ("alpha beta gamma delta river stone cloud window garden letter number paper silver golden morning evening travel "
         "simple reason market").split()


def sentence(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


#: Texts that any operator must take: null, empty, spaces only, long with and without spaces, odd characters.
ODD = [None, "", "   ", "\n\n\n", "x", "word " * 30_000, "y" * 50_000, " " * 20_000 + "end", "é ß 漢字 🙂 naïve\r\n\ttab",
       "<|endoftext|> it's 'tis 12345  double"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, two rows repeated, a null id, and columns whose names operators use for their results."""
    rows = [(i, t, "en", "src0", 7, "c", 1.5) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "some text without an id", None, None, None, None, None)]
    rows += [(100 + i, sentence(i), "en" if i % 2 else "de", "src1", 1, "d", 2.5) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
