"""Toxic rows of rare words are found although they are few."""

from basketry.llm import quality
from tests.llm.test_operators import frame


def test_quality_rare_toxic_words(spark):
    # a few words of their own mark the toxic rows, which are of good quality in all else
    def text(i):
        plain = [f"w{(i * k * 31 + k) % 97}" for k in range(1, 40)]
        return " ".join(plain + ([f"vile{'abc'[(i // 10 + k) % 3]}" + "." * (k % 2) for k in range(3)] if i % 10 == 0 else []))

    docs = frame(spark, [text(i) if i % 7 else "BUY!! NOW!! ***" for i in range(600)])
    labels = [(i, int(i % 7 != 0), int(i % 10 == 0 and i % 7 != 0)) for i in range(400)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    assert kept & set(range(400, 600)) == {i for i in range(400, 600) if i % 7 and i % 10}
