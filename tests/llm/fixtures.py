"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 200)
    edited = base.split()
    edited[50] = "changed"
    other = prose(2, 300)
    return [
        (1, base),
        (2, base),
        (3, " ".join(edited)),
        (4, other),
        (5, None),
        (6, ""),
        (7, "   \n\t "),
        (8, "one two"),
        (9, "one  two"),
        (10, "é😀 ÀÉÎ naïve — 日本語 ß ǅ İ Σ ΑΣ"),
        (11, "x" * 30_000),
        (12, "ab " * 20_000),
        (13, prose(3, 5_000)),
        (14, "Write to jo.doe@mail.example.com or +1 (555) 010-9999 about 10.0.0.255 and 4111 1111 1111 1111 now"),
        (15, "you idiot " * 3 + prose(4, 50)),
        (8, "one two"),  # a repeated row
        (16, other[:900] + " " + prose(5, 80)),
        (None, base),
        (None, None),
    ]


def table(spark, rows=None):
    """The rows with columns that carry the names of computed ones."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if k % 5 == 0 else f"s{k % 3}", "en" if k % 2 else "de", float(k), True, "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, score double, kept boolean, spans string, n_tokens int")


def empty(spark):
    return spark.createDataFrame([], table(spark).schema)
