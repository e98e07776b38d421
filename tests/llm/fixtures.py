"""Small documents with the awkward cases that every operator must take."""

import random

TYPES = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, label string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alder birch cedar dogwood elm fir gum hazel iris juniper kauri larch maple nutmeg oak pine quince rowan spruce teak".split()) + str(r.randrange(30)) for _ in range(n))


def awkward():
    """(doc_id, text): null and repeated ids, null, blank and very long texts, repeated rows, ties."""
    long = "\n".join(words(12, i) for i in range(1500))
    return [(0, words(120, 1)), (1, words(120, 1)), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, words(3, 2)), (None, words(60, 3)), (7, words(60, 4)), (7, words(60, 4)), (7, words(60, 5)), (8, "é́ “quotes” 日本語 <|endoftext|> #$%" + words(20, 6)), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t) if t else 0, 9, 0.5, "x") for i, t in rows], TYPES)


def tables(spark, folder, rows, labels=(), benchmark=()):
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)
