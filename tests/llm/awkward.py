"""A table with nulls, empty and long texts, copies, repeated rows, ties and columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, component string, batch int, length int, had int, own string, key string, kept string, held int, part string, m string, block long"

MORE = (1, "o", "k", "t", 0, "p", "m", 5)


def rows():
    long = "alpha beta gamma delta " * 6000
    texts = [None, "", " ", "one", "one two three", "x" * 70, long, long, "Ünï çödé ☃ " * 40, "a b c d e f g h i j k l m n o p"]
    out = [(n, t, None, "s", None, 7, "f", "c", 1, 2, *MORE) for n, t in enumerate(texts)]
    return [*out, out[3], out[3], (50, "a b c d e f g h i j k l m n o p", "en", None, 3, None, None, None, None, None, *[None] * 8)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
