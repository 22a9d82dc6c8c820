"""Small tables that every operator must take: nulls in any column, repeats, clashing extra columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, kept string, size string, score string, row_uid string"


def documents(spark, rows):
    """Documents from (doc_id, text, source), with extra columns whose names operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def simple(spark, texts):
    return documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
