"""Rows that operators must get through: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

PASSAGE = "a passage of quite some length that several documents share word for word, éñß, and then go on"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoé") for _ in range(r.randint(1, 9))) for _ in range(n))


def documents():
    base = words(1, 120)
    edited = base.split(" ")
    edited[7], edited[90] = "CHANGED", "other"
    rows = [
        (1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "one"), (5, "One two THREE four"), (6, "one two three four"),
        (7, base), (8, base), (9, base.upper()), (10, " ".join(edited)), (11, base + " " + words(2, 4)),
        (12, words(3, 50) + " " + PASSAGE + " " + words(4, 30)), (13, PASSAGE + "\n" + words(5, 40)), (14, words(6, 20) + PASSAGE),
        (15, "a" * 700), (16, "b" + "a" * 300), (17, "ha " * 200), (18, "é" * 60 + "ñ" * 60), (19, "ñ" * 70 + "x" + "é" * 40),
        (20, words(7, 30000)), (21, words(7, 30000)[5000:9000]), (22, base), (22, base), (23, words(8, 60)), (23, words(9, 60)),
        (24, "\n".join([words(10, 9)] * 3 + [words(11, 30)])), (25, "# $ % & * | < > " * 20 + words(12, 30)), (26, words(13, 34)), (27, words(13, 35)), (28, words(13, 36)),
        (29, "x\x00y \x1c z \x85 q　r <|endoftext|> it's they'll  end"), (30, PASSAGE[:49]), (31, PASSAGE[:50]), (32, PASSAGE[:51]), (33, "日本語のテキスト" * 20), (-5, base + " z"),
    ]
    return rows


CLASHING = "id n a b rep token block bucket keys text_lc host path rule _id _text x y score kept sig n_words rank".split()


def frame(spark, rows=None):
    """documents with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)
