"""Customer segments against nearest centres in SQL, and product rules against counting by hand."""

import datetime as dt
import itertools
import random

import duckdb
import pytest

from basketry.operators import customers
from basketry.operators.recommend import product_rules, recommend, visit_baskets
from basketry.operators.segments import segment_customers
from basketry.plans.catalog import enriched_from_tables
from basketry.schemas import ENRICHED_SCHEMA
from tests.conftest import SF_SMALL

FEATURES = "cliente_id int, frecuencia long, total_cantidad long, productos_distintos long, categorias_distintas long"


def test_every_customer_has_its_nearest_centre(spark):
    found = segment_customers(customers.customer_features(enriched_from_tables(spark, SF_SMALL)))
    assigned, segments = found.assigned.toPandas(), found.segments.toPandas()  # noqa: F841
    wrong = duckdb.sql(
        """with d as (
          select a.cliente_id, a.segment, s.segment as other, list_distance(a.scaled, s.centre) as far
          from assigned a, segments s
        )
        select count(*) from d x join d y using (cliente_id) where x.segment = x.other and y.far < x.far - 1e-9"""
    ).fetchall()[0][0]
    assert wrong == 0
    per = duckdb.sql("select segment, count(*), avg(total_cantidad) from assigned group by 1 order by 1").fetchall()
    assert per == [(r.segment, r.clientes, pytest.approx(r.media_total_cantidad)) for r in segments.sort_values("segment").itertuples()]
    assert [n for _, n, _ in per] == sorted((n for _, n, _ in per), reverse=True)
    again = segment_customers(customers.customer_features(enriched_from_tables(spark, SF_SMALL))).silhouettes
    assert again.keys() == found.silhouettes.keys()


def test_clear_groups_are_found(spark):
    rng = random.Random(1)
    centres = [(2, 5, 3, 1), (50, 400, 90, 9), (200, 900, 20, 2)]
    rows = [(i, *[c + rng.randint(0, 2) for c in centres[i % 3]]) for i in range(90)]
    found = segment_customers(spark.createDataFrame(rows, FEATURES))
    assert max(found.silhouettes, key=found.silhouettes.get) == 3
    by_group = {}
    for r in found.assigned.collect():
        by_group.setdefault(r.cliente_id % 3, set()).add(r.segment)
    assert sorted(map(sorted, by_group.values())) == [[1], [2], [3]]


@pytest.mark.parametrize("rows", [[], [(1, 1, 1, 1, 1)], [(1, 1, 1, 1, 1), (2, 9, 9, 9, 9)], [(i, 4, 4, 4, 4) for i in range(9)], [(1, None, 1, 1, 1)]])
def test_too_few_different_customers(spark, rows):
    found = segment_customers(spark.createDataFrame(rows, FEATURES))
    kept = [r for r in rows if None not in r]
    assert [r.segment for r in found.assigned.collect()] == [1] * len(kept)
    assert [r.clientes for r in found.segments.collect()] == ([len(kept)] if kept else [])


def test_rules_and_recommendations(spark):
    rng = random.Random(4)
    rows = []
    for v in range(120):
        bought = rng.sample(range(12), rng.randint(1, 6)) + [0] * (v % 2)
        rows += [(dt.date(2013, 1, 1 + v % 28), v // 28, v, p, 1, None, None) for p in bought]
    baskets = visit_baskets(spark.createDataFrame(rows, ENRICHED_SCHEMA))
    sets = {}
    for d, b, c, p, *_ in rows:
        sets.setdefault((d, b, c), set()).add(p)
    n = len(sets)
    alone = {p: sum(p in s for s in sets.values()) for p in range(12)}
    want = {}
    for x, y in itertools.permutations(range(12), 2):
        both = sum(x in s and y in s for s in sets.values())
        if both >= 9 and both / alone[x] >= 0.25:
            want[x, y] = (both, both / n, both / alone[x], both / alone[x] / (alone[y] / n))
    rules = product_rules(baskets, 9, 0.25)
    got = {(r.producto_id, r.recomendado): tuple(r)[2:] for r in rules.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {}
    for r in recommend(rules, 2).collect():
        best.setdefault(r.producto_id, []).append((r.puesto, r.recomendado))
    for x in {x for x, _ in want}:
        order = sorted((y for a, y in want if a == x), key=lambda y: (-want[x, y][2], -want[x, y][3], y))[:2]
        assert sorted(best[x]) == [(i + 1, y) for i, y in enumerate(order)]
    assert product_rules(baskets.limit(0)).count() == 0
