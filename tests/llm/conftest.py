"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, words string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def awkward_rows() -> list[tuple]:
    r = random.Random(5)
    word = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() + r.choice(["", "", ".", ","]) for _ in range(n))
    shared, line = prose(60), prose(14)
    near = line.split()
    near[6] = "changed"
    texts = {
        1: shared, 2: shared, 3: "", 4: None, 5: " \n\t ", 6: prose(30) + " " + shared + " " + prose(30), 7: line + "\n" + prose(25) + "\n" + line,
        8: " ".join(near) + "\n" + prose(20), 9: prose(9000), 10: "same " * 50, 11: "x" * 3000, 12: "two  spaces\n\n and éß中",
        13: " ".join(near[:-1]) + "\nshort\nshort", 14: "same " * 50, 15: "one", 16: prose(200) + "\n" + line, 17: "one<|endoftext|>two",
    }
    rows = [(i, t, "en" if i % 2 else "xx", None, None, 0.5, 7, "w") for i, t in texts.items()]
    return [*rows, rows[0], (None, "no id here at all", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    return VOCABULARY
