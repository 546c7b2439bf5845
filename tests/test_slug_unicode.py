"""Slugs of all characters without Python in the plan."""

import re
import unicodedata

from gatewright.functions.text import slug
from gatewright.plans import catalog


def test_slug_of_every_character(spark):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["x" + "".join(chars[i : i + 97]) + "ß y" for i in range(0, len(chars), 97)] + [None, "", "½ﬁ№", "½"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = [re.sub("[^a-z0-9]+", "_", unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()).strip("_") or "quest" for t in texts]
    assert [r.s for r in df.select("i", slug("t").alias("s")).orderBy("i").collect()] == want


def test_slugs_are_made_without_python(spark):
    assert "Python" not in catalog.QUERIES["q_slug_accents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
