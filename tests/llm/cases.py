"""Documents that operators have to stand: nulls, blanks, long texts, ties, repeated rows, odd columns."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# names that operators use themselves
CLASHING = (
    "key", "size", "taken", "fp", "root", "node", "component_id", "n_words", "ids", "row", "start", "words",
    "spans", "cell", "lang_pred", "score", "count", "part", "shard", "kept", "copies", "__row", "rank",
    "rows", "own", "copy", "pieces", "passes", "__pieces", "__key", "__own", "__kept", "__copy", "__source", "__row_1", "first",
)


def words(text):
    return WORD.findall(text or "")


def phrase(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    shared = phrase(1, 60)
    long_text = phrase(2, 30_000, 5_000)
    rows = [
        (1, phrase(10, 80) + "\n" + shared, "en", "a", 1),
        (2, shared + "  " + phrase(11, 50), "fr", "a", None),
        (3, None, "en", "b", 0),
        (4, "", None, None, 0),
        (5, " \t\n\x0b\x0c\r ", "de", None, 7),
        (6, long_text, "en", "c", None),
        (7, long_text.replace("w7 ", "W7 ", 3), "en", "c", None),
        (8, phrase(12, 40), "en", "é", None),
        (8, phrase(12, 40), "en", "é", None),
        (9, phrase(12, 40), None, "d", None),
        (None, phrase(13, 45), "en", "a", None),
        (10, "Ünï cödé   don't 'sit <|endoftext|> 日本語 x́ İ ½ 1234", "de", "b", None),
        (11, "one", "en", "b", None),
        (12, "12 34 !! ??", "es", "b", None),
        (13, "a\n\nb  c\td \x1c e", "fr", "b", None),
    ]
    return rows


def odd_docs(spark, clashing=True):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING}) if clashing else docs


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(name, sf_dir="/root/testdata/sf0.001"):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


class Groups:
    """A plain union-find to check against."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
