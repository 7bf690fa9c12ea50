import random

SCHEMA = "doc_id long, text string, class string, token string, key string, n int, row string, spans string, text_hash string, n_chars long, `group` string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]


def frame(spark, pairs):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "c", "t", "k", 1, "r", "s", "h", len(t or ""), "g") for i, t in pairs], SCHEMA)


def edge_cases():
    """Nulls, empty and blank texts, one word, ties, repeated rows."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Tie tie TIE tie"), (6, "tie tie tie tie"), (6, "tie tie tie tie"), (None, "lost"), (7, "é ß 漢字 🔺 end")]


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def changed(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
    return " ".join(w)
