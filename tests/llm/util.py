"""Small document tables with the awkward cases."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double"
ODD = [(None, "null id text of five words", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", "b"), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, "dup dup dup dup dup dup dup", "en", "c"), (6, "dup dup dup dup dup dup dup", "en", "c"), (7, "ünïcödé ✓ 🙂 text ßß", "de", "a"), (8, "w" * 50_000 + " " + "word " * 20_000, "en", "a")]


def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5) for r in ODD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows):
    """(doc_id, text) rows with the other columns filled."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.0) for i, t in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (4, 0, 1), (5, 1, 0), (7, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
