import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

ODD_TEXTS = [None, "", " \t\n", "one", "Two words　here", "é" * 50, "x " * 3000, "x" * 20000, "a b c", "A B  C", "# $ %", "\x0b\x0c \r"]
SYLLABLES = "the an re on ti ou er ing ed sh ble th es wh ha or in at".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): fresh texts, a large group of near copies, exact copies, shared passages, odd texts, a
    repeated row and a null id."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 3)))
    texts = [" ".join(word() for _ in range(pick.randint(1, 220))) for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(120):
        copy = list(base)
        for _ in range(pick.randint(0, 6)):
            copy[pick.randrange(len(copy))] = word() + str(pick.randint(0, 9))
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40 + [" \n".join(base).upper()] * 2
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):
        texts.append(" ".join(word() for _ in range(pick.randint(0, 80))) + " " + passage + " " + " ".join(word() for _ in range(pick.randint(0, 80))))
    loop = " ".join(word() for _ in range(20))
    texts += [" ".join([loop] * 6), *ODD_TEXTS, *ODD_TEXTS]
    pick.shuffle(texts)
    rows = [(k, t, "en", f"src{k % 4}" if k % 9 else None) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(5)
