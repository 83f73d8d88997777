"""Rows for the edge cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, gone string, TAG int, kept string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(vocabulary) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "other"
    line = "This line of the license text is much longer than forty characters"
    texts = [
        (1, None), (2, ""), (3, " \n\t\n "), (4, base), (5, base), (6, " ".join(near)), (7, prose(2, 4000)), (8, "ab " * 3000),
        (9, prose(3, 80) + "\n" + line), (10, f"  {line.upper()}\t\n{prose(4, 60)}"), (11, f"{line}\n{line}"), (12, line), (13, line + "\n"),
        (14, line.replace(" ", " ")), (15, prose(5, 60) + " " + base), (15, prose(6, 30)), (16, base), (16, base), (None, base),
        (None, None), (17, "\x00\x01 \U0001f600 é́"), (18, "x" * 70000), (19, base.upper()),
    ]
    return [
        (i, t, None if k % 3 else "en", [None, "a", "b", "ünï"][k % 4], None, k, "x", k, "y") for k, (i, t) in enumerate(texts)
    ]


def frame(spark, some=None, partitions: int = 3):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(partitions)


def pairs(some=None) -> list[tuple]:
    return [(r[0], r[1] or "") for r in (rows() if some is None else some)]


def as_set(df, *columns):
    """Rows as a sorted list, so that repeated rows count."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
