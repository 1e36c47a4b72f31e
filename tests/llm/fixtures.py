"""Small tables with the cases every operator must bear, and texts for them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep string, `unit` int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    shared = " ".join(words(rng, 60))
    base = words(rng, 120)
    out = {}
    for i in range(40):
        out[i] = " ".join(words(rng, rng.randrange(1, 150)))
    for i in range(40, 52):  # near copies: two words changed
        w = list(base)
        w[i - 40], w[i + 10] = "x1", "x2"
        out[i] = " ".join(w)
    for i in range(52, 57):  # exact copies but for white space
        out[i] = " \t".join(base) if i % 2 else "  ".join(base)
    for i in range(57, 62):  # a passage that repeats
        out[i] = " ".join(words(rng, 20)) + "\n" + shared + "\n" + " ".join(words(rng, 15))
    out[62] = (shared + " ") * 3  # repeats within one document
    out[63], out[64], out[65], out[66] = "", None, "one", "one"
    out[67] = "längere Wörter ñ \u00a0 😀 " * 30
    out[68] = " ".join(words(rng, 30_000, 5_000))  # very long
    out[69] = "   lead and trail   "
    return out


def documents(spark, empty=False):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t), 0.5, "r", 1) for i, t in texts().items()]
    rows += [rows[3], rows[41], rows[64]]  # repeated rows
    rows += [(None, "no id at all", None, None, None, None, None, None), (None, texts()[5], None, "s1", None, None, None, None)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]
