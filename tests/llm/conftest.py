import random

import pytest

#: Columns whose names the operators use inside.
CLASH = {"size": "int", "shard": "string", "part": "double", "k_id": "long", "gone": "string", "_thash": "long", "n": "int", "key": "string", "h": "int", "block": "int", "copies": "long", "words": "string", "_id": "long", "taken": "long"}


def sentence(r, n):
    return " ".join("".join(r.choice(["ka", "mo", "ri", "te", "su", "on", "el", "ña"]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): copies, near copies, shared passages, ties, nulls, blanks, a long text, repeated rows."""
    r = random.Random(7)
    rows, n = [], 0
    bases = ["\n".join(sentence(r, r.randint(5, 14)) + "." for _ in range(r.randint(4, 9))) for _ in range(24)]
    passage = "\n".join(sentence(r, 12) for _ in range(4))
    for i, b in enumerate(bases):
        rows.append((n, b, f"s{i % 3}"))
        n += 1
        if i % 3 == 0:
            rows += [(n + k, b, "s0") for k in range(3)]
            n += 3
        if i % 4 == 0:
            for _ in range(4):
                words = b.split(" ")
                words[r.randrange(len(words))] = "other"
                rows.append((n, " ".join(words), "s0"))
                n += 1
        if i % 5 == 0:
            rows.append((n, b[: len(b) // 2] + "\n" + passage + "\n" + sentence(r, 20), None))
            n += 1
    rows += [(n, None, "s1"), (n + 1, "", "s1"), (n + 2, "   \n\t ", None), (n + 3, "one two", "s2"), (n + 4, "One two", "s2"), (n + 5, "a b c d e", "é"), (n + 6, "aaaa" * 300, "s1")]
    rows.append((n + 7, "\n".join(sentence(r, 15) for _ in range(400)) + passage, "s2"))
    rows.append(rows[3])
    rows.append((None, bases[1], "s1"))
    rows.append((-5, bases[2] + "\nend", "s9"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    extra = ", ".join(f"`{c}` {t}" for c, t in CLASH.items())
    blank = [None] * len(CLASH)
    return spark.createDataFrame([(*row, len(row[1] or ""), *blank) for row in corpus], f"doc_id long, text string, source string, n_chars long, {extra}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
