"""Independent SQL (DuckDB dialect) for each registered query.

Each string is self-contained: the proxy views are common table expressions
over the driver's tables.  Every computed column is aliased to the name the
Spark query produces; integer sums are cast to BIGINT (DuckDB sums INT to
HUGEINT) and ratios to DOUBLE.
"""

from __future__ import annotations

# Stated here once more, so that a wrong label in the library shows.
_WEEKDAYS = {1: "Dom", 2: "Lun", 3: "Mar", 4: "Mié", 5: "Jue", 6: "Vie", 7: "Sáb"}
_FEATURES = {
    "frecuencia": "Frecuencia",
    "total_cantidad": "Total cantidad",
    "productos_distintos": "Prod. distintos",
    "categorias_distintas": "Cat. distintas",
}

_VIEWS = """
with fx_all as (
  select cast(o.o_orderdate as date) as fecha, c.c_nationkey as sucursal_id,
         cast(o.o_custkey as int) as cliente_id, cast(l.l_partkey as int) as producto_id, o.o_orderkey
  from orders o join customer c on c.c_custkey = o.o_custkey join lineitem l on l.l_orderkey = o.o_orderkey
),
fx_fact as (select * from fx_all where true),
fx_product_category as (
  select cast(p_partkey as int) as producto_id, cast(substr(p_brand, 7) as int) as categoria_id from part where p_size <= 25
  union all
  select cast(p_partkey as int), p_size from part where p_size <= 10
),
fx_categories as (
  select distinct cast(substr(p_brand, 7) as int) as categoria_id, p_brand as nombre_categoria from part
),
fx_enriched as (
  select f.fecha, f.sucursal_id, f.cliente_id, f.producto_id, cast(1 as int) as cantidad, m.categoria_id, k.nombre_categoria
  from fx_fact f
  left join (select producto_id, min(categoria_id) as categoria_id from fx_product_category group by producto_id) m
    on m.producto_id = f.producto_id
  left join fx_categories k on k.categoria_id = m.categoria_id
),
fx_visits as (select distinct fecha, sucursal_id, cliente_id from fx_enriched),
fx_daily as (select fecha, count(*) as n_transacciones from fx_visits group by fecha),
fx_customer_units as (
  select cliente_id, cast(sum(cantidad) as bigint) as total_cantidad from fx_enriched group by cliente_id
),
fx_features as (
  select cliente_id,
         count(distinct strftime(fecha, '%Y-%m-%d') || '#' || cast(sucursal_id as varchar)) as frecuencia,
         cast(sum(cantidad) as bigint) as total_cantidad,
         count(distinct producto_id) as productos_distintos,
         count(distinct categoria_id) as categorias_distintas
  from fx_enriched group by cliente_id
),
fx_share as (
  select nombre_categoria, total_cantidad, n_productos,
         round(cast(total_cantidad as double) / cast(sum(total_cantidad) over () as double) * 100.0, 2) as pct
  from (select nombre_categoria, cast(sum(cantidad) as bigint) as total_cantidad,
               count(distinct producto_id) as n_productos
        from fx_enriched where nombre_categoria is not null group by nombre_categoria)
),
fx_box as (
  select quantile_cont(total_cantidad, 0.25) as q1, quantile_cont(total_cantidad, 0.5) as mediana,
         quantile_cont(total_cantidad, 0.75) as q3, avg(total_cantidad) as media
  from fx_customer_units
),
fx_fences as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from fx_box)
"""


def _sql(body: str) -> str:
    return _VIEWS + body


def _weekday_case(expr: str) -> str:
    whens = " ".join(f"when {k} then '{v}'" for k, v in _WEEKDAYS.items())
    return f"coalesce(case {expr} {whens} end, '?')"


def _corr_sql() -> str:
    cols = list(_FEATURES)
    parts = []
    for a in cols:
        for b in cols:
            parts.append(
                f"select '{_FEATURES[a]}' as var_x, '{_FEATURES[b]}' as var_y, "
                f"round(corr(cast({a} as double), cast({b} as double)), 6) as r from fx_features"
            )
    return "\n union all ".join(parts)


_DOW = "cast(dayofweek(fecha) + 1 as integer)"

ORACLE_SQL: dict[str, str] = {
    "ingest_baskets": _sql(
        """select strftime(fecha, '%Y-%m-%d') as fecha, sucursal_id, cliente_id,
       string_agg(cast(producto_id as varchar), ' ' order by producto_id) as productos_raw
from fx_fact group by o_orderkey, fecha, sucursal_id, cliente_id"""
    ),
    "ingest_product_category": _sql("select producto_id, categoria_id from fx_product_category"),
    "ingest_categories": _sql("select categoria_id, nombre_categoria from fx_categories"),
    "explode_baskets": _sql(
        "select strftime(fecha, '%Y-%m-%d') as fecha, sucursal_id, cliente_id, producto_id from fx_fact"
    ),
    "parse_dates": _sql(
        """select strftime(fecha, '%Y-%m-%d') as fecha_txt, fecha
from (select distinct o_orderkey, fecha from fx_fact)"""
    ),
    "category_dedupe": _sql(
        "select producto_id, min(categoria_id) as categoria_id from fx_product_category group by producto_id"
    ),
    "enrich": _sql("select * from fx_enriched"),
    "enriched_roundtrip": _sql(
        """select sucursal_id, count(*) as n_rows, cast(sum(cantidad) as bigint) as n_units
from fx_enriched group by sucursal_id"""
    ),
    "visits": _sql("select fecha, sucursal_id, cliente_id from fx_visits"),
    "total_units": _sql("select cast(coalesce(sum(cantidad), 0) as bigint) as value from fx_enriched"),
    "total_visits": _sql("select count(*) as value from fx_visits"),
    "unique_counts": _sql(
        "select count(distinct cliente_id) as n_clientes, count(distinct producto_id) as n_productos from fx_enriched"
    ),
    "top_products": _sql(
        """select producto_id, 'Producto ' || cast(producto_id as varchar) as label, total_cantidad,
       format('{:,}', total_cantidad) as texto
from (select producto_id, cast(sum(cantidad) as bigint) as total_cantidad from fx_enriched
      group by producto_id order by total_cantidad desc, producto_id asc limit 10)"""
    ),
    "top_customers": _sql(
        """select cliente_id, 'Cliente ' || cast(cliente_id as varchar) as label, n_transacciones,
       format('{:,}', n_transacciones) as texto
from (select cliente_id, count(*) as n_transacciones from fx_visits
      group by cliente_id order by n_transacciones desc, cliente_id asc limit 10)"""
    ),
    "daily_visits": _sql("select strftime(fecha, '%Y-%m-%d') as fecha, n_transacciones from fx_daily"),
    "peak_days": _sql(
        f"""select strftime(fecha, '%Y-%m-%d') as fecha, n_transacciones, {_DOW} as dia_semana,
       {_weekday_case(_DOW)} as dia,
       strftime(fecha, '%Y-%m-%d') || '<br>' || {_weekday_case(_DOW)} || '<br>'
         || format('{{:,}}', n_transacciones) || ' transacciones' as hover
from (select * from fx_daily order by n_transacciones desc, fecha asc limit 30)"""
    ),
    "category_share": _sql("select nombre_categoria, total_cantidad, n_productos, pct from fx_share"),
    "category_pie": _sql(
        """select nombre_categoria, cast(sum(total_cantidad) as bigint) as total_cantidad, round(sum(pct), 2) as pct
from (select pct < 3.0 as small, case when pct < 3.0 then 'Otros' else nombre_categoria end as nombre_categoria,
             total_cantidad, pct from fx_share)
group by small, nombre_categoria having sum(total_cantidad) > 0"""
    ),
    "rolling_7d": _sql(
        """select strftime(fecha, '%Y-%m-%d') as fecha, n_transacciones,
       case when count(*) over w = 7 then avg(n_transacciones) over w end as rolling_7d
from fx_daily window w as (order by fecha rows between 3 preceding and 3 following)"""
    ),
    "customer_units": _sql("select cliente_id, total_cantidad from fx_customer_units"),
    "customer_features": _sql(
        "select cliente_id, frecuencia, total_cantidad, productos_distintos, categorias_distintas from fx_features"
    ),
    "customer_corr": _sql(_corr_sql()),
    "customer_box": _sql(
        """select q1, mediana, q3, media,
       (select cast(min(total_cantidad) as double) from fx_customer_units, fx_fences
         where total_cantidad >= lo and total_cantidad <= hi) as bigote_inf,
       (select cast(max(total_cantidad) as double) from fx_customer_units, fx_fences
         where total_cantidad >= lo and total_cantidad <= hi) as bigote_sup,
       (select count(*) from fx_customer_units, fx_fences
         where total_cantidad < lo or total_cantidad > hi) as n_outliers
from fx_box"""
    ),
    "customer_outliers": _sql(
        """select cliente_id, total_cantidad from fx_customer_units, fx_fences
where total_cantidad < lo or total_cantidad > hi"""
    ),
    "stream_ingest": _sql("select sucursal_id, count(*) as n_units from fx_enriched group by sucursal_id"),
    "latest_per_key": """select event_type, event_id, ts, user_id, value, props
from (select *, row_number() over (partition by event_type order by event_id desc) as rn from events)
where rn = 1""",
    "recent_n": "select * from events order by event_id desc limit 20",
}

_KPI_SQL = _sql(
    """select 'total_unidades' as kpi, cast(coalesce(sum(cantidad), 0) as bigint) as value from fx_enriched
union all select 'total_visitas', (select count(*) from fx_visits)
union all select 'clientes_unicos', count(distinct cliente_id) from fx_enriched
union all select 'productos_unicos', count(distinct producto_id) from fx_enriched
union all select 'categorias_con_nombre', count(distinct nombre_categoria) from fx_enriched
union all select 'unidades_sin_categoria', cast(coalesce(sum(case when nombre_categoria is null then cantidad end), 0) as bigint)
  from fx_enriched
union all select 'productos_sin_categoria', count(distinct case when categoria_id is null then producto_id end) from fx_enriched"""
)
ORACLE_SQL["source_manifest"] = _sql(
    """select sucursal_id as branch, cast(sum(strlen(line) + 1) as bigint) as size
from (select sucursal_id, strftime(fecha, '%Y-%m-%d') || '|' || sucursal_id || '|' || cliente_id || '|'
             || string_agg(cast(producto_id as varchar), ' ') as line
      from fx_fact group by o_orderkey, fecha, sucursal_id, cliente_id)
group by sucursal_id"""
)
ORACLE_SQL["manifest_diff"] = _sql(
    """select sucursal_id as branch, case when not bool_or(newest) then 'unchanged'
            when bool_and(newest) then 'added' else 'modified' end as change
from (select sucursal_id, year(fecha) >= (select max(year(o_orderdate)) from orders) as newest from fx_fact)
group by sucursal_id"""
)


def _units_sql(where: str = "") -> str:
    return _sql(
        f"""select sucursal_id, count(*) as n_rows, cast(sum(cantidad) as bigint) as n_units, count(nombre_categoria) as n_named
from fx_enriched {where} group by sucursal_id"""
    )


ORACLE_SQL["etl_full"] = ORACLE_SQL["batch_then_stream"] = _units_sql()
ORACLE_SQL["etl_incremental"] = _units_sql("where year(fecha) < (select max(year(o_orderdate)) from orders)")
ORACLE_SQL["stream_then_batch"] = _units_sql()
ORACLE_SQL["kpi_bundle"] = _KPI_SQL
ORACLE_SQL["unique_counts_partials"] = ORACLE_SQL["unique_counts"]

# mart -> (key, whole columns in order of their names; those with a dot hold six digits)
_MARTS = {
    "kpis": ("kpi_bundle", "kpi value"),
    "top_products": ("top_products", "label producto_id texto total_cantidad"),
    "top_customers": ("top_customers", "cliente_id label n_transacciones texto"),
    "peak_days": ("peak_days", "dia dia_semana fecha hover n_transacciones"),
    "category_share": ("category_share", "n_productos nombre_categoria .pct total_cantidad"),
    "category_pie": ("category_pie", "nombre_categoria .pct total_cantidad"),
    "daily_series": ("rolling_7d", "fecha n_transacciones .rolling_7d"),
    "customer_box": ("customer_box", ".bigote_inf .bigote_sup .media .mediana n_outliers .q1 .q3"),
    "customer_outliers": ("customer_outliers", "cliente_id total_cantidad"),
    "customer_corr": ("customer_corr", ".r var_x var_y"),
}


def _marts_sql(where: str = "true") -> str:
    """All marts as (mart, entry) over the receipts that satisfy ``where``."""

    def text(column: str) -> str:
        shown = f"printf('%.6f', {column[1:]})" if column.startswith(".") else f"cast({column} as varchar)"
        return f"coalesce({shown}, 'null')"

    parts = []
    for mart, (key, columns) in _MARTS.items():
        body = ORACLE_SQL[key].removeprefix(_VIEWS)
        entry = " || '|' || ".join(text(c) for c in columns.split())
        parts.append(f"select '{mart}' as mart, {entry} as entry from ({body})")
    views = _VIEWS.replace("where true", f"where {where}")
    return views + "\nunion all\n".join(parts)


ORACLE_SQL["product_rules"] = _sql(
    """, fx_bought as (select distinct fecha, sucursal_id, cliente_id, producto_id from fx_enriched),
fx_alone as (select producto_id, count(*) as n from fx_bought group by producto_id),
fx_total as (select count(*) as n from fx_visits),
fx_pairs as (
  select a.producto_id, b.producto_id as recomendado, count(*) as n_visitas
  from fx_bought a join fx_bought b using (fecha, sucursal_id, cliente_id) where a.producto_id <> b.producto_id
  group by a.producto_id, b.producto_id having count(*) >= 2
)
select p.producto_id, p.recomendado, n_visitas, round(n_visitas / cast(t.n as double), 9) as soporte,
       round(n_visitas / cast(x.n as double), 9) as confianza,
       round((n_visitas / cast(x.n as double)) / (y.n / cast(t.n as double)), 9) as lift
from fx_pairs p join fx_alone x on x.producto_id = p.producto_id join fx_alone y on y.producto_id = p.recomendado, fx_total t"""
)
ORACLE_SQL["kpi_mart_roundtrip"] = ORACLE_SQL["kpi_partials_roundtrip"] = _marts_sql()
_NEWEST = "(select max(year(o_orderdate)) from orders)"
ORACLE_SQL["etl_partials_incremental"] = _marts_sql(
    f"(year(fecha) < {_NEWEST} and sucursal_id < 10) or (year(fecha) >= {_NEWEST} and month(fecha) <= 6)"
)
ORACLE_SQL["etl_rejects"] = _sql(
    """select sucursal_id, count(*) filter (not spoilt) as n_units, count(distinct o_orderkey) filter (spoilt) as n_rejects
from (select *, sucursal_id >= 10 and day(fecha) % 5 = 0 as spoilt from fx_fact where sucursal_id <= 20)
group by sucursal_id"""
)
