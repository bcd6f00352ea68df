import pytest

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, copies, and columns with names that operators use."""
    rows = [
        (1, f"alpha beta {PASSAGE} gamma", "en", "a"), (2, f"delta {PASSAGE} epsilon\n\nzeta", "en", "a"), (2, f"delta {PASSAGE} epsilon\n\nzeta", "en", "a"),
        (3, None, None, None), (4, "", "de", "b"), (None, f"eta {PASSAGE}", "fr", None), (None, "short", None, "b"), (5, LONG, "en", "c"), (6, LONG, "en", "c"),
        (7, "x" * 900, "es", "c"), (8, "é" * 350 + " tail", "fr", "c"), (9, " \t\n ", "en", "b"), (10, "one two", "en", "b"), (11, "one two", "en", "b"),
        (12, "a # b # c\na # b # c\nplain line " + " ".join(f"u{k}" for k in range(60)), "en", "a"),
    ]
    names = ("th", "id", "h", "own_id", "own_th", "own_nth", "own_hash", "mix_id", "mix_take", "__id", "__th", "__h", "__n", "__t", "__k", "__takes", "__w", "__g", "n_words", "n_bytes", "carried_0", "kept_id", "`a.b`", "Size")
    rows = [(*r, len(r[1] or ""), "x", ["y"], *[7] * len(names)) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, kept array<string>, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
