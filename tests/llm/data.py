"""Small seeded texts with copies, near copies, shared passages, odd characters and edges."""

import random


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 160)) for _ in range(6)]
    shared = words(rng, 70, 5000)
    out = []
    for k in range(n):
        kind = rng.randrange(6)
        own = list(rng.choice(base)) if kind < 3 else words(rng, rng.randrange(1, 200), 3000)
        if kind == 1:
            for _ in range(rng.randrange(1, 6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
        if kind == 4:
            at = rng.randrange(len(own) + 1)
            own[at:at] = shared
        out.append(" ".join(own))
    return [*out, None, "", "   ", "one", "One", "é\n\tü 日本 😀", "ab " * 300, "x" * 5000, "ab " * 300]


def frame(spark, values, extra=False):
    rows = [(7 * k + 3, t, "key", k) for k, t in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, th int")
    return df.repartition(5) if extra else df.select("doc_id", "text").repartition(5)
