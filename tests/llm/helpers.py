"""Rows that every operator must bear."""

LONG = "one two three four five " * 20_000


def documents(spark, rows):
    """A documents table with an extra column whose name clashes with results."""
    data = [(i, t, lang, source, None if t is None else len(t), "mine") for i, t, lang, source in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string")


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", None, None), (4, "word", "en", "a"), (4, "word", "en", "a"),
    (None, "a text without id", "fr", "b"), (None, None, None, None), (5, LONG, "en", "a"), (6, LONG, "en", "b"),
    (7, "x" * 300_000, "de", "b"), (8, "\x00 nul ퟿ \U0001f600 　 end", "en", "a"),
]
