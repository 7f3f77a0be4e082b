"""Small document tables with the awkward cases every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
#: Names that operators use themselves.
CLASHING = ("text_key", "dropped_lines", "row_no", "words", "took", "turn", "language", "id", "key", "kind", "row", "edits")
DOCS += "".join(f", {c} string" for c in CLASHING)


def awkward(spark, n=40):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew tea in the old stone tower"
    rows = [
        (1, None, "en", "a", None, 0.5, "x"),
        (2, "", "en", "b", 0, None, None),
        (3, "   \n\t ", None, None, 6, 1.0, "y"),
        (4, "12345 !!! 678", "en", "a", 13, 1.0, "y"),
        (5, "word " * 20_000, "en", "a", 100_000, 1.0, "y"),
        (6, "x" * 50_000, "fr", "b", 50_000, 1.0, "y"),
        (7, base, "en", "a", len(base), 1.0, "y"),
        (7, base, "en", "a", len(base), 1.0, "y"),
        (8, base, "en", None, len(base), 1.0, "y"),
        (9, base.replace("seven", "eight"), "en", "c", len(base), 1.0, "y"),
        (None, base + " again", "en", "c", 0, None, None),
        (10, "é ü ñ — ß x \n y", "de", "c", 0, None, None),
    ]
    for i in range(11, 11 + n):
        rows.append((i, " ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(base.split())) + f"\nline {i} of the text here\nall rights are reserved here", ("en", "fr", "de")[i % 3], "abc"[i % 3], 10, float(i), "z"))
    return spark.createDataFrame([(*r, *(f"own {c}" for c in CLASHING)) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def untouched(out):
    """Whether columns with clashing names came through as they were."""
    return all({r[0] for r in out.select(c).distinct().collect()} <= {f"own {c}"} for c in CLASHING if c in out.columns)
