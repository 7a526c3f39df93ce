"""Small document tables for the tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, clashing=False):
    """Rows of (doc_id, text) or (doc_id, text, source); `clashing` adds columns that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clashing:
        for name in ("block", "payload", "size", "shard", "kept", "n_words", "component_id", "host", "key", "id", "n", "line", "target", "pos", "count"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def odd_documents(seed=0):
    """Nulls, empty, long and repeated texts, ties, and what the scans and rules look for."""
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "be", "the", "Über", "x#y", "de", "for", "ñu", "end."]) + str(rng.randint(0, 40)) * rng.randint(0, 1)
    prose = lambda n: "".join(word() + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))
    rows = [(i, prose(rng.choice([1, 20, 60, 200])), rng.choice(["s1", "s2", "s2", "s2", "", None, "Z", "é"])) for i in range(60)]
    line = "This line stands on every page of the host"
    rows += [(100 + i, f"{line}\n" * rng.randint(1, 3) + prose(3 + 60 * (i % 2)), "s2") for i in range(110)]
    key = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", k=40))
    rows += [
        (300, None, "s1"),
        (301, "", "s1"),
        (302, " \n\t", None),
        (None, "no id here", None),
        (303, prose(20_000), "s1"),
        (304, f"password = '{key}' and Token:abc API_key=\"{key[:12]}\" apikey=short passwd:{key}", "s1"),
        (305, f"AKIA{'Q' * 16} AKIAX {'0123456789abcdef' * 3} deadbeef é{'ab12' * 5}", "s1"),
        (306, f"blob {key} uuid 123e4567-e89b-12d3-a456-426614174000 path some-long-name/with-words/2024 EXAMPLE{key}", "s1"),
        (307, f"é{key}{key[::-1]} " + "=" * 30 + f" {key[:20]}+/{key[:5]} " + "F3a91C" * 6, "s1"),
        (308, "secret=" + "a" * 11 + " secret=" + "a" * 12, "s1"),
        (309, " ".join(f"token={'x1' * 8}{i}" for i in range(700)), "s1"),
        (310, "one two three one two three one two three", "s3"),
    ]
    return rows + [(400, "the same row " * 20, "s2")] * 5


def against_oracle(spark, folder, name, tables):
    """Write tables, run a query and its SQL over them; None or what differs."""
    from suite.check import difference
    from tierflow.llm.queries import ORACLES, QUERIES

    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}")
        part = next(folder.joinpath(table).glob("part-*.parquet"))
        part.rename(folder / f"{table}.parquet")
    return difference(QUERIES[name](spark, str(folder)), str(folder), ORACLES[name])
