"""Small conversation tables for the tests."""

import random

from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ("conv", "place", "code", "gaps", "letter", "same", "kind", "audit", "cost", "node", "depth", "seq", "parent", "words", "is_end")


def conversations(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING if clashing else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def odd_conversations(seed=0):
    """Nulls, blank, long and repeated turns, ties, odd roles, and conversations that share their beginnings."""
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "end. ", "trail.\n", "", " \t", "über.", "…", None, "a longer answer with words"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "student"]
    rows = []
    for conv in [*range(45), 60, 61, 79, 100, -7, -40, None]:
        shape = rng.random()
        for turn in range(rng.choice([0, 1, 2, 4, 9])):
            role = rng.choice(roles) if shape < 0.6 else "ua"[turn % 2].replace("u", "user").replace("a", "assistant", 1)
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, rng.choice(texts)))
    rows += [(200, 1, "user", "the same row."), (200, 1, "user", "the same row."), (200, 1, "user", "another row.")]
    rows += [(202 + i, t, ["user", "assistant"][t % 2], f"turn {t}.") for i in range(6) for t in range(2 + i % 3)]
    rows += [(300, t, ["user", "assistant"][t % 2], f"long {t % 700}.") for t in range(2500)]
    rows += [(301, 0, "user", "word " * 50_000), (302, 0, None, None), (303, None, None, None)]
    return rows
