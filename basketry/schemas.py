"""Fixed schemas of the inputs and of the enriched fact."""

from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

CORRUPT_COLUMN = "_corrupt_record"

# Receipt line: fecha|sucursal_id|cliente_id|productos_raw, no header.
# fecha stays text so that the date parse is ours (try_to_date, invalid -> dropped).
RAW_BASKET_SCHEMA = StructType(
    [
        StructField("fecha", StringType(), True),
        StructField("sucursal_id", IntegerType(), True),
        StructField("cliente_id", IntegerType(), True),
        StructField("productos_raw", StringType(), True),
    ]
)

# Product -> category bridge; the file header is ignored and columns are mapped by position.
PRODUCT_CATEGORY_SCHEMA = StructType(
    [
        StructField("producto_id", IntegerType(), True),
        StructField("categoria_id", IntegerType(), True),
    ]
)

CATEGORY_SCHEMA = StructType(
    [
        StructField("categoria_id", IntegerType(), True),
        StructField("nombre_categoria", StringType(), True),
    ]
)

ENRICHED_COLUMNS = [
    "fecha",
    "sucursal_id",
    "cliente_id",
    "producto_id",
    "cantidad",
    "categoria_id",
    "nombre_categoria",
]

ENRICHED_SCHEMA = StructType(
    [
        StructField("fecha", DateType(), True),
        StructField("sucursal_id", IntegerType(), True),
        StructField("cliente_id", IntegerType(), True),
        StructField("producto_id", IntegerType(), True),
        StructField("cantidad", IntegerType(), True),
        StructField("categoria_id", IntegerType(), True),
        StructField("nombre_categoria", StringType(), True),
    ]
)

VISIT_KEY = ["fecha", "sucursal_id", "cliente_id"]

# Storage-only: the slice of the table that a row belongs to, a hash of its source
# file (0 for rows without one).  Readers of the table never see it.
LOTE_COLUMN = "lote"


def with_corrupt_column(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(CORRUPT_COLUMN, StringType(), True)])
