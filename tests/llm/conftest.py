import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, starts string"
WORDS = "the of and to in that is for it with as was on by alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and a hot source."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randrange(5, 120)) for _ in range(60)]
    passage = prose(rnd, 45)
    texts += [prose(rnd, 30) + "\n" + passage + "\t" + prose(rnd, 30) for _ in range(8)]
    texts += [texts[3]] * 5 + [texts[4] + " end", "Start " + texts[4]]
    base = prose(rnd, 400)
    texts += [base + f" v{i}" for i in range(12)]
    texts += ["", None, " \n\t ", "one", "ab", "a b c", "È ñ ü 🙂 ▁ x\x00y", " ".join(["spam"] * 60), "### $$$ %%% " * 30, (prose(rnd, 50) + "\r\n") * 3, prose(rnd, 9000), "tail  two   spaces \n", "<|endoftext|> <s> <0x0A>"]
    out = []
    for i, t in enumerate(texts):
        out.append((3 * i, t, rnd.choice(["en", "fr", None, "xx"]), "hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), None if t is None else len(t), "k", "s"))
    out += [out[10], (None, texts[5], "en", "a", 1, "k", "s"), (None, "only null id " + prose(rnd, 30), "en", "a", 1, "k", "s"), (30, prose(rnd, 40), "de", "b", 5, "k", "s")]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
