import pytest

#: Columns that operators use inside must not clash with the caller's.
CLASHES = (
    "words word pos w words_ n start window_id window_words covered _id lines rest hash k row fp smallest root node score predicted"
    " held_out toxic ids n_tokens n_bytes n_lines n_removed lang_pred value path label _first h m n_words n_hit contaminated"
).split()


@pytest.fixture(scope="session")
def docs(spark):
    """Build ``(doc_id, text)`` documents; ``clash=True`` adds columns with names that operators use inside."""

    def make(rows, clash=False, parts=3):
        d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        if clash:
            from pyspark.sql import functions as F

            d = d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
        return d

    return make


#: Nulls, empties, blanks, repeated rows, ties, one long text.
MESSY = [
    (None, "a null key with some words in it"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"),
    (6, "repeated row of words here"), (6, "repeated row of words here"), (7, "repeated row of words here"),
    (8, "Ünïcödé ΑΣ İ 中文 🙂 word's they'll 123 !!! ﬁ"), (9, "!!! ??? 123 --- 45"),
    (10, " ".join(f"w{i % 977} the Of\n" for i in range(20_000))), (11, "x" * 50_000), (12, "line\nline\nline\nline\nline\nother"),
]


@pytest.fixture(scope="session")
def messy():
    return MESSY
