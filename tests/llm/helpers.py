"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, label string"


def awkward(spark):
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "the same text of a document, more or less, said once", "en", "a", 1),
        (2, "the  same text of a document,\tmore or less, said once", "en", "b", 2),
        (2, "the  same text of a document,\tmore or less, said once", "en", "b", 2),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, "   \n\t ", "en", "c", 6),
        (6, long_text, "en", "a", len(long_text)),
        (None, "the same text of a document, more or less, said once", "en", "a", 3),
        (7, "Größe   naïve \U0001f600 \x1c x\x00y", "de", "é", 9),
        (8, "one", "en", "z", 3),
        (9, "ONE", "en", "z", 3),
    ]
    return spark.createDataFrame([(*r, "k", "s", "l") for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
