"""Small document tables with every awkward case."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents from (doc_id, text) or whole rows; the extra columns clash with names that operators use inside."""
    full = [(*r, None, None, None)[:5] for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in ("key", "size", "range", "hash", "n", "start", "score", "h", "lo", "kept"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


AWKWARD = [(0, "one two three"), (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (None, "null id"), (5, "é" * 300), (6, "word " * 5000), (7, "x" * 20000)]
