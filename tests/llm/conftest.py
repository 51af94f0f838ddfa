import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns named like the operators' own
            from pyspark.sql import functions as F

            for name in ("shard", "size", "fp", "score", "words", "th", "pos", "n_words", "length", "piece", "family", "lines", "a.b", "__n"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with ties, repeats, nulls, empties, blanks, a very long one, and near copies."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "pi7", "rho"]

    def text(n):
        return "".join(rng.choice(words) + (rng.choice(["\n", ". ", "\t"]) if rng.random() < 0.2 else " ") for _ in range(n))

    rows = [(i, text(rng.randint(1, 120))) for i in range(60)]
    base = text(150)
    rows += [(100 + i, base) for i in range(12)]
    for i in range(12):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "   \n\n "), (303, "one"), (304, "one"), (305, text(20_000)), (306, "a b c\n" * 40), (307, "!?***"), (42, rows[42][1]), (42, "another text with the same id"), (None, "no id at all here"), (None, None)]
    return rows
