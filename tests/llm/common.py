"""Inputs that several tests share."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, stems=("ta", "ri", "mon", "bel", "sho", "ke", "lu", "vind", "or", "pa")) -> list[str]:
    """Invented words."""
    return ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def documents(spark, texts, clash: bool = False):
    """A table of texts (id, text) with the other columns of documents; ``clash`` adds columns with names that operators use."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clash:
        for name in ("score", "ids", "class", "n_tokens", "node", "p", "words", "a", "begin"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


ODD = [(1, None), (2, ""), (3, "a"), (None, "no id at all"), (4, "a a a a"), (4, "a a a a"), (5, "long " * 20000), (6, "  \t\n "), (7, "é\U0001f600 ü don't 12  x<|endoftext|>y")]
