"""Text functions against a plain Python account of what they do."""

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T

ALPHABET = "ab1 \t\n\r\x00\x07\x1c\x85\xa0\xad​ ﻿　é́“”’—…·."


def python_sanitize(t: str) -> str:
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xad​-‏﻿\xa0]", "", t)
    t = "\n".join(line.rstrip() for line in re.split(r"\r\n|[\r\n\x85  ]", t))
    return re.sub(r"\n{4,}", "\n\n\n", t).strip()


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", expression.alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_sanitize_equals_python(spark):
    sample = texts(1500)
    assert column(spark, sample, T.sanitize("t")) == [python_sanitize(t) for t in sample]


def test_sanitize_keeps_a_blank_for_a_no_break_space_when_told(spark):
    assert column(spark, ["a\xa0b", None, ""], T.sanitize("t", nbsp_to_space=True)) == ["a b", None, ""]


def test_unicode_normalize(spark):
    table = str.maketrans({**dict.fromkeys("‘’‚", "'"), **dict.fromkeys("“”„", '"'), **dict.fromkeys("–—―", "-"), "…": "...", "﻿": "", "\xa0": " "})
    sample = texts(500, 2)
    assert column(spark, sample, T.unicode_normalize("t")) == [unicodedata.normalize("NFC", t).translate(table) for t in sample]
    assert column(spark, ["ﬁ", None], T.unicode_normalize("t", nfkc=True)) == ["fi", None]


def test_clean_for_chunking_equals_python(spark):
    def clean(t):
        t = re.sub(r"(?<!\w)((\w) )+(\w)(?!\w)", lambda m: m.group().replace(" ", ""), t)
        return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()

    rng = random.Random(3)
    sample = ["".join(rng.choice("ab1é_ \t\n-") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert column(spark, sample, T.clean_for_chunking("t")) == [clean(t) for t in sample]


def test_base_name(spark):
    names = ["/a/b/c.pdf", "c.pdf", "/a/b/", "", "/", "a//b//", "x/.hidden", None]
    assert column(spark, names, T.base_name("t")) == ["c.pdf", "c.pdf", "b", "unknown", "unknown", "b", ".hidden", None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=20))
def test_strip_and_words_equal_python(spark, sample):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(sample)], "i int, t string").select("i", T.strip("t").alias("s"), T.word_count(F.col("t")).alias("w")).orderBy("i").collect()
    assert [(r["s"], r["w"]) for r in rows] == [(t.strip(), len(t.split())) for t in sample]
