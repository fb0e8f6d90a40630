"""Every stage of the pipeline against plain Python, with null ids, null texts, repeated rows, near copies and odd columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_pair_operators import _components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the farmer counts all of his sheep before he walks slowly over the old bridge and sells them at the small market"


def _documents():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(600)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([12, 40, 150]))) for _ in range(100)]
    for i in range(0, 100, 5):  # near copies
        w = texts[i].split()
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    texts += [texts[3], texts[4], texts[4]]  # exact copies
    texts += [f"BUY!! NOW!! *** CHEAP{i}!! PILLS!!" for i in range(60)]
    texts += [f"{' '.join(rng.choices(vocabulary, k=20))} {ITEM} {' '.join(rng.choices(vocabulary, k=9))}" for _ in range(6)]
    rows = [(i, t, ["en", "de", None][i % 3], ["web", "book", None, "web"][i % 4], len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[7], "en", "web", 5), (None, f"see {ITEM}", "en", "web", 9), (None, None, None, None, None), (900, None, "en", "web", 0), (901, "", "en", "web", 0)]
    return rows + [rows[9]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    rows = _documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(r[0], int("BUY" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_quality_drops_junk_alone(spark, tables):
    root, rows = tables
    kept = _sorted(corpus_pipeline.quality(spark, _docs(spark, rows), root).collect())
    want = _sorted(r for r in rows if "BUY" not in (r[1] or ""))
    lost = Counter(map(str, want)) - Counter(map(str, kept))
    assert not Counter(map(str, kept)) - Counter(map(str, want)) and sum(lost.values()) <= 4


def test_near_dedup_keeps_the_least_of_each_group(spark, tables):
    root, rows = tables
    got = _sorted(corpus_pipeline.near_dedup(spark, _docs(spark, rows), root).collect())
    component = {i: c for i, _, c in _components([(r[0], r[1]) for r in rows], 5, 80)}
    assert got == _sorted(r for r in rows if r[0] is None or component[r[0]] == r[0])


def test_decontamination_drops_the_passages(spark, tables):
    root, rows = tables
    got = _sorted(corpus_pipeline.decontamination(spark, _docs(spark, rows), root).collect())
    assert got == _sorted(r for r in rows if ITEM not in (r[1] or ""))


def test_mixing_takes_parts_of_documents(spark, tables):
    root, rows = tables
    rows = list(dict.fromkeys(rows))
    docs = _docs(spark, rows)
    out = corpus_pipeline.mixing(spark, docs, root)
    assert out.columns == docs.columns
    size, taken = Counter(), Counter()
    whole = {(r[0], r[3]): Counter((r[1] or "").split()) for r in rows if r[0] is not None}
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    for r in out.collect():
        words = r.text.split()
        taken[r.source] += len(words)
        assert words and r.n_chars == len(r.text)
        assert r.doc_id is None or not Counter(words) - whole[r.doc_id, r.source]
    total, order = sum(size.values()), sorted((s for s in size if s), key=str) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] if s in full else level * weight[s] for s in (full or free)}
        free -= full or free
    assert all(abs(taken[s] - target[s]) <= 128 and taken[s] <= 3 * size[s] for s in order)


def test_sharding_is_gapless(spark, tables):
    root, rows = tables
    got = corpus_pipeline.sharding(spark, _docs(spark, rows), root).collect()
    assert _sorted(tuple(r)[:5] for r in got) == _sorted(rows)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == corpus_pipeline.N_SHARDS and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_run_goes_through_all_stages(spark, tables):
    root, rows = tables
    got = corpus_pipeline.run(spark, root).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    assert got and not any("BUY" in r.text or ITEM in r.text for r in got)
    component = {i: c for i, _, c in _components([(r[0], r[1]) for r in rows], 5, 80)}
    ids = {r.doc_id for r in got} - {None}
    assert ids and len({component[i] for i in ids}) == len(ids)
    assert sorted(Counter(r["shard"] for r in got)) == list(range(corpus_pipeline.N_SHARDS))


def test_empty_documents(spark, tables, tmp_path):
    root, _ = tables
    empty = _docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0, name
