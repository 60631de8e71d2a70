import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(seed=5):
    """Texts with shared passages, exact and near copies, repeated lines, odd characters, and a very long one."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) + ("\n" if r.random() < 0.06 else "") for _ in range(n))
    passage, other = prose(80), prose(70)
    texts = {}
    for i in range(40):
        texts[i] = prose(r.randint(1, 150))
    for i in range(40, 50):
        texts[i] = prose(20) + " " + passage + "\n" + prose(15)
    for i in range(50, 55):
        texts[i] = texts[3]
    for i in range(55, 63):  # chains of near copies
        w = texts[i - 1].split(" ") if i > 55 else (prose(120)).split(" ")
        w[r.randrange(len(w))] = "changed%d" % i
        texts[i] = " ".join(w)
    texts[63], texts[64] = "", None
    texts[65] = " \n\t "
    texts[66] = "a " * 400
    texts[67] = "x" * 1500 + " tail"
    texts[68] = "<|endoftext|> in the middle <|endoftext|>  end \U0001f600   x"
    texts[69] = "Same line number 12 of the report, with words\n" * 3 + "Same line number 345 of the report, with words\nother"
    texts[70] = other + " " + passage + " " + other + " " + other
    texts[71] = prose(6000) + passage + prose(3000)
    texts[72] = "one two"
    texts[73] = "ONE two"
    texts[74] = passage[:130]
    texts[-7] = "negative identifier " + passage
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def table(spark, texts):
    rows = [(i, t, None if i % 3 else "en", "src%d" % (i % 2), None) for i, t in texts.items()]
    rows.append((None, "a row without an identifier", "en", None, 1))
    # columns with the names that operators use inside
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in ("bucket", "payload", "kept", "row", "digest", "label")}).repartition(3)


@pytest.fixture(scope="session")
def empty(table):
    return table.where("false")


@pytest.fixture(scope="session")
def plain(texts):
    return {i: t or "" for i, t in texts.items()}


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i < 40), 0) for i in texts if i >= 0] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")
