import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to red blue green fish boat tree stone water north south cold warm old new ships sail slowly over waves Über été niño 42 x9".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared lines, nulls, empty and long texts, ties and repeated rows."""
    r = random.Random(7)
    out = []
    passage = sentence(r, 60)
    for k in range(60):
        lines = [sentence(r, r.randint(4, 30)) for _ in range(r.randint(1, 6))]
        if k % 4 == 0:
            lines.insert(1, f"Copyright 20{k:02d} by the people of the north, all rights reserved here.")
        if k % 7 == 0:
            lines.append(passage)
        out.append((k, "\n".join(lines), r.choice(["en", "de", None]), r.choice(["a", "b", "hot", "hot", "hot", None]), 0))
    base = out[5][1]
    out += [(100 + k, base.replace(" ", "  " if k % 2 else "\t"), "en", "hot", 0) for k in range(12)]
    out += [(120 + k, base + " " + WORDS[k], "en", "hot", 0) for k in range(12)]
    out += [(140, None, None, None, None), (141, "", "en", "a", 0), (142, " \n\t", "en", "a", 3), (None, base, "en", "a", 1), (143, "one", "de", "b", 3), (143, "one", "de", "b", 3)]
    out += [(150, sentence(r, 9000), "en", "a", 0), (151, "x" * 20000, "en", "a", 0), (152, "Straße 北京。漢字 и слова " * 40, "de", "b", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
