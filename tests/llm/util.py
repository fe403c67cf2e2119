import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def rest(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


#: Nulls, empty and blank texts, repeated rows and a repeated id, ties, and columns whose names clash with an operator's own.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 9),
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 9),
    (2, None, "en", "b", 9),
    (3, "", None, None, 9),
    (4, " \t\n ", "fr", None, 9),
    (5, "one two", "en", "a", 9),
    (6, "THE quick brown fox jumps over the lazy dog and runs far away from here", None, "c", None),
    (None, "texte sans numéro ni rien d'autre à dire pour le moment", "fr", "a", 9),
    (7, "été à la plage " * 400, "fr", "b", 9),
    (8, "x" * 5000, "en", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    from pyspark.sql import functions as F

    names = ["score", "node", "digest", "size", "batch", "item", "hash", "component", "held_out", "p"]
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in names})


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
