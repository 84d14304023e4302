"""Small inputs with every case that the operators must take."""

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


def hard_documents(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns whose names
    the operators use themselves."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf tonight"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " again", "en", None, 1),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \n\t ", "en", "b", 3), (7, LONG, "en", "a", 9),
        (8, "drei Wörter hier", "de", "c", 3), (9, "drei Wörter hier", "de", "c", 3), (None, base, None, None, None),
        (None, None, None, None, None), (10, "1234 5678 !!", None, "a", 2), (11, LONG + " end", "en", "a", 9),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("id", "size", "n", "h", "key", "item", "label", "shard", "kept", "features", "cut", "mark", "score", "pairs")
    return df.withColumns({c: F.lit("x") for c in clash})


def empty_documents(spark):
    return hard_documents(spark).limit(0)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, None]
