"""Documents without an id are mixed like others, also where sources share a text."""

from collections import Counter

from basketry.llm import mixing
from tests.llm.test_operators import SCHEMA, tokens


def test_null_ids_are_kept(spark):
    texts = [" ".join([f"w{i}"] * (20 * (i % 7) + 1)) for i in range(120)]
    rows = [(None if i % 3 == 0 else i, t, "en", f"s{i % 2}", len(t), 7, "clash", 1, "x") for i, t in enumerate(texts)]
    rows += [(None, "shared " * 50, "en", s, 350, 7, "clash", 1, "x") for s in ("s0", "s1", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.taken_words(docs, block_words=16).collect()
    out = mixing.mixed_documents(docs, block_words=16).collect()
    assert sum(len(tokens(r.text)) for r in out) == sum(r.taken for r in taken)
    targets = {(r.source_size, r.target) for r in taken}
    got = Counter()
    for r in out:
        got[r.source] += len(tokens(r.text))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    assert all(abs(got[s] - dict(targets)[n]) <= 32 for s, n in sizes.items())
    assert any(r.doc_id is None and r.text.startswith("w0") for r in out)
