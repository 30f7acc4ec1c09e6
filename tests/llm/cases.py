"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names the operators use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "ng")]


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + 15]) for i in range(0, n, 15))


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for i in r.sample(range(len(words)), n):
        words[i] = "zz" + str(r.randrange(10**6))
    return " ".join(words)


def rows() -> list[tuple]:
    base = [prose(i) for i in range(6)]
    out = [(i, t, "en", "s") for i, t in enumerate(base)]
    out += [(10, base[0], "en", "s"), (11, base[0], "en", "s"), (12, edited(base[1], 1, 2), "en", "s"), (13, edited(base[1], 2, 2), "en", "s")]
    out += [(20, None, None, None), (21, "", "en", None), (22, " \t\n ", "en", "s"), (23, "one", "en", "s"), (24, "One", "fr", "s"), (25, "%%% 123 !!", "en", "s")]
    out += [(30, prose(99, 30_000), "en", "s"), (31, "été " * 50, "fr", "s"), (31, "été " * 50, "fr", "s"), (None, "no id " + base[5], "en", "s"), (32, "x" * 5000, "de", "s")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def table(spark, own=None):
    return spark.createDataFrame(rows() if own is None else own, SCHEMA).repartition(5)


def clashing(spark, own=None):
    """Extra columns with names that operators use for themselves."""
    from pyspark.sql import functions as F

    df = table(spark, own)
    for name in ("id", "node", "n", "key", "digest", "score", "lang_pred", "n_lines", "n_dropped", "n_bytes", "n_tokens", "shard", "size", "slot", "part", "kind", "name", "kept", "line", "pos", "n_entities", "rep", "root", "__id", "__t", "__n", "__x", "__p", "__pos", "__line", "__drop", "__text", "__letters", "__size", "__order", "__row", "__own_n_lines"):
        df = df.withColumn(name, F.lit("mine"))
    return df
