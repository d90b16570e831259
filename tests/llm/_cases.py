"""Awkward documents that every operator must take: nulls in any column, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class long, key string, `range` int, _id int, `a.b` int, i long, `rank` int, _row string, whole int, target int"


def awkward(spark):
    base = "The quick brown fox jumps over the lazy dog and runs far away from the old stone house"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, "   \t\n ", "fr", "b", 5),
        (None, "un texte sans identifiant avec quelques mots de plus", "fr", None, 7),
        (None, None, None, None, None),
        (6, "word " * 30000, "en", "c", 150000),
        (7, base + " again", "en", "c", 1),
        (8, "12345 !!! ???", "de", "a", 13),
        (9, "Das ist ein kurzer Satz über nichts \U0001f600 und mehr", "de", "b", 40),
        (10, "a", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, 9, "k", 3, 4, 5, 6, 7, "r", 8, 9) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated(spark, n=1000):
    """A third and more of all rows have one id: equal texts, and different ones."""
    texts = ["the cat sat on the mat and looked at the old stone house", "der Hund lief durch den Wald und suchte das alte Haus", "le chat dort sur le tapis de la vieille maison grise"]
    rows = [(7, texts[0], "en", "a")] * (n - n // 10) + [(7, f"{texts[1]} {k}", "de", "a") for k in range(n // 10)]
    rows += [(100 + k, f"{texts[k % 3]} {k}", ("en", "de", "fr")[k % 3], "b") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
