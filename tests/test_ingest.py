"""CSV scans (S1-S3): PERMISSIVE read, rejects, header and CRLF handling."""

from pyspark.sql import functions as F

from basketry.operators.etl import run_transformations
from basketry.operators.visits import visits
from basketry.sources.csv import read_basket_rejects, read_baskets, read_categories, read_product_category

EDGE_LINES = [
    "2013-01-01|102|530|20 3 1",
    "2013-01-01|102|587|6 29 43 ",
    "2013-01-01|102|588| 7  8",
    "2013-01-01|102|588|7 7",
    "2013-01-02|102|589|",
    "2013-01-02|102|590",
    "2013-01-02|102|x|5 6",
    "2013-01-02|102|591|5 6|extra",
    "2013-13-45|102|592|5 5",
    "2013-01-03|102|593|5 a",
    "2013-01-03|102|594|99999999999 4",
]


def _dims(spark):
    pc = spark.createDataFrame([(20, 7), (20, 3), (6, 1)], "producto_id int, categoria_id int")
    cats = spark.createDataFrame([(1, "Uno"), (3, "Tres")], "categoria_id int, nombre_categoria string")
    return pc, cats


def test_edge_lines_rejects_units_visits(spark, write_lines):
    d = write_lines("tx", "102_Tran.csv", EDGE_LINES)
    raw = read_baskets(spark, d)
    rejects = read_basket_rejects(spark, d)
    assert raw.count() == 8
    assert rejects.count() == 3
    # a pruned query sees the same accepted lines as a full one
    assert raw.select("cliente_id").count() == 8
    assert set(r.archivo for r in rejects.collect()) == {"102_Tran.csv"}
    pc, cats = _dims(spark)
    fact = run_transformations(raw, pc, cats)
    assert fact.count() == 12
    assert fact.agg(F.sum("cantidad")).first()[0] == 12
    assert visits(fact).count() == 5
    # bad token and overflow keep only the good token
    kept = {r.cliente_id: r.n for r in fact.groupBy("cliente_id").agg(F.count("*").alias("n")).collect()}
    assert kept == {530: 3, 587: 3, 588: 4, 593: 1, 594: 1}


def test_branch_glob_union(spark, write_lines):
    write_lines("multi", "102_Tran.csv", ["2013-01-01|102|1|1 2"])
    d = write_lines("multi", "103_Tran.csv", ["2013-01-01|103|1|3"])
    write_lines("multi", ".DS_Store", ["garbage"])
    raw = read_baskets(spark, d, pattern="*_Tran.csv")
    assert sorted(r.sucursal_id for r in raw.collect()) == [102, 103]


def test_product_category_header_ignored(spark, write_lines):
    d = write_lines("pc", "ProductCategory.csv", ["v.Code_pr|v.code", "1007|3", "1008|4", "bad|x"])
    pc = read_product_category(spark, d)
    assert sorted(tuple(r) for r in pc.collect()) == [(1007, 3), (1008, 4)]


def test_categories_crlf_no_final_newline(spark, write_lines):
    d = write_lines("cat", "Categories.csv", ["1|BEBIDAS", "2|LACTEOS", "3|PAN"], newline="\r\n", final_newline=False)
    cats = read_categories(spark, d)
    assert sorted(tuple(r) for r in cats.collect()) == [(1, "BEBIDAS"), (2, "LACTEOS"), (3, "PAN")]
