"""The operations table: column names, types and the headers they arrive under."""

from __future__ import annotations

from pyspark.sql import types as T

OPERATIONS_SCHEMA = T.StructType(
    [
        T.StructField("operation_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("buyer_id", T.StringType()),
        T.StructField("buyer_name", T.StringType()),
        T.StructField("buyer_city", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("seller_name", T.StringType()),
        T.StructField("seller_city", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("business_value", T.DoubleType()),
        T.StructField("commission", T.DoubleType()),
        T.StructField("referrer", T.LongType()),
        T.StructField("pct_ref_sale", T.DoubleType()),
        T.StructField("pct_ref_purchase", T.DoubleType()),
        T.StructField("principal", T.StringType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("month_name", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("registered_on", T.DateType()),
    ]
)

# Headers of the source files, as users' exports name them.
SOURCE_COLUMNS = {
    "OPERACION": "operation_id",
    "CC PPAL": "client_id",
    "CLIENTE": "client_name",
    "NIT COMPRADOR": "buyer_id",
    "NOMBRE COMPRADOR": "buyer_name",
    "CIUDAD COMPRADOR": "buyer_city",
    "NIT VENDEDOR": "seller_id",
    "NOMBRE VENDEDOR": "seller_name",
    "CIUDAD VENDEDOR": "seller_city",
    "NOMBRE PRODUCTO": "product",
    "VALOR NEGOCIO": "business_value",
    "COMISION": "commission",
    "REFERENCIADOR": "referrer",
    "% REF VENTA": "pct_ref_sale",
    "% REF COMPRA": "pct_ref_purchase",
    "PRINCIPAL": "principal",
    "TIPO OPERACION": "operation_type",
    "MES": "month_name",
    "YEAR": "year",
    "FECHA REGISTRO": "registered_on",
}
