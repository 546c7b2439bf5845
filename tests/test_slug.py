"""The registered slug queries take the whole text."""

import re
import unicodedata

from gatewright.plans import catalog

LONG = "Über " * 20 + "the END of a long text!"


def test_slugs_of_whole_texts(spark, tmp_path):
    texts = {1: LONG, 2: "a" * 61 + "b", 3: "???" + " " * 60 + "x", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def expected(t, form):
        s = unicodedata.normalize("NFKD", t) if form else t
        return re.sub("[^a-z0-9]+", "_", s.encode("ascii", "ignore").decode().lower()).strip("_") or "quest"

    for name, form in (("q_slug_accents", True), ("q_slug_ascii_whole", False)):
        assert dict(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == {d: expected(t, form) for d, t in texts.items()}
