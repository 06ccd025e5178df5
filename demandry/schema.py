"""Names and fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Movement kinds as written in the input files.
SALE_LABEL = "Venta"
PRODUCTION_LABEL = "Producción"

# Kinds used in our own tables.
SALE = "sale"
PRODUCTION = "production"

# Input headers of the daily movement ledger.
REQUIRED = ["Fecha", "Producto_id", "Producto_nombre", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior"]
OPTIONAL = [
    "Año", "Mes", "Dia", "Empresa_cliente", "Departamento_cliente", "Canal_venta", "Punto_venta",
    "Precio_unitario", "Descuento_pct", "Valor_total", "Campana", "Costo_unitario",
]
LEDGER_COLUMNS = [
    "Fecha", "Año", "Mes", "Dia", "Producto_id", "Producto_nombre", "Empresa_cliente", "Departamento_cliente",
    "Canal_venta", "Punto_venta", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior",
    "Precio_unitario", "Descuento_pct", "Valor_total", "Campana", "Costo_unitario",
]
LEGACY_REQUIRED = ["Codigo", "Fecha", "Documento", "Entrada_unid", "Salida_unid", "Saldo_unid"]
LEGACY_COLUMNS = [
    "Codigo", "Descripcion", "Fecha", "Documento", "Numero", "Bodega", "Entrada_unid", "Salida_unid", "Saldo_unid",
    "Valor_Unitario", "Costo_Unitario", "precio_base", "descuento_pct", "valor_total",
]

# Input header -> our name.
LEDGER_NAMES = {
    "Fecha": "date", "Año": "year", "Mes": "month_no", "Dia": "day", "Producto_id": "product_id",
    "Producto_nombre": "product_name", "Empresa_cliente": "client", "Departamento_cliente": "department",
    "Canal_venta": "channel", "Punto_venta": "pos", "Tipo_movimiento": "kind", "Cantidad": "qty",
    "Stock_anterior": "stock_before", "Stock_posterior": "stock_after", "Precio_unitario": "unit_price",
    "Descuento_pct": "discount_pct", "Valor_total": "total_value", "Campana": "campaign", "Costo_unitario": "unit_cost",
}
LEGACY_NAMES = {
    "Codigo": "product_id", "Descripcion": "product_name", "Fecha": "date", "Documento": "doc", "Numero": "doc_no",
    "Bodega": "warehouse", "Entrada_unid": "in_units", "Salida_unid": "out_units", "Saldo_unid": "stock_after",
    "Valor_Unitario": "unit_price", "Costo_Unitario": "unit_cost", "precio_base": "base_price",
    "descuento_pct": "discount_pct", "valor_total": "total_value",
}
NUMERIC = {"qty", "stock_before", "stock_after", "unit_price", "discount_pct", "total_value", "unit_cost", "in_units", "out_units", "base_price"}
# Names a stock table may give to its measure, in the order they are looked for.
STOCK_MEASURES = ["Saldo_unid", "Stock_Unid", "Stock_posterior", "Stock_final"]

STOCK_TOLERANCE = 0.01

# Document codes of the older ledger, by role.
DOC_STORE_SALE = "VO"
DOC_CONSUMPTION = "CO"
DOC_GUIDE = "GU"

# Labels of reconciled guides.
GUIDE_TRANSFER = "TRANSFERENCIA_INTERNA"
GUIDE_EXTERNAL = "VENTA_EXTERNA"
GUIDE_NONE = "NO_GUIA"

# Document label -> sales channel.
DOCUMENT_CHANNEL = {
    "Entrada por Producción": None,
    "Entrada por Compra": None,
    "Salida por Consumo": "consumo_interno",
    "Venta Tienda Sin Doc": "mostrador",
    "Guia de remision - R": "distribuído",
}
# Warehouse -> region.
WAREHOUSE_REGION = {
    "Almacen Central": "Centro",
    "Almacen Punto de Ventas 1": "Norte",
    "Almacen Punto de Venta 2": "Sur",
    "Almacen Punto de Venta 3": "Este",
}
# Keyword -> product type, first match wins.
TYPE_KEYWORDS = [
    (("caja",), "caja"),
    (("bandeja",), "bandeja"),
    (("tuberia", "conduit"), "tuberia"),
    (("gabinete",), "gabinete"),
    (("tapa",), "tapa"),
    (("curva", "union", "tee"), "accesorios"),
]
OTHER_TYPE = "otros"
# Product type -> (cost min, cost max, price min, price max).
PRICE_BANDS = {
    "caja": (1.50, 3.50, 4.00, 8.00),
    "bandeja": (2.00, 4.00, 5.00, 9.00),
    "tuberia": (1.00, 2.50, 2.50, 7.00),
    "gabinete": (2.50, 4.50, 6.00, 10.00),
    "tapa": (0.80, 2.00, 2.00, 5.00),
    "accesorios": (0.60, 1.50, 1.50, 4.50),
    "otros": (1.50, 3.00, 3.50, 8.50),
}
MARGIN_FLOOR = 1.3
ABSURD_VALUE = 100000.0

# Service level by class and Z by service level.
SERVICE_LEVEL = {"A": 0.95, "B": 0.90}
SERVICE_LEVEL_OTHER = 0.85
Z_BY_SERVICE_LEVEL = [(0.85, 1.04), (0.90, 1.28), (0.95, 1.65), (0.975, 1.96), (0.99, 2.33)]
Z_DEFAULT = 1.65
ABC_CUTS = (0.80, 0.95)

# Role -> permissions.
ROLE_PERMISSIONS = {
    "master_admin": [
        "view_all_orgs", "manage_organizations", "manage_all_users", "manage_all_data", "view_audit_logs", "upload_data",
    ],
    "org_admin": ["manage_org_users", "upload_data", "view_org_data", "manage_org_settings"],
    "viewer": ["view_org_data"],
}
MASTER_ROLE = "master_admin"

# Month names used in reports.
MONTH_NAMES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]


def text_schema(names: list[str]) -> T.StructType:
    """All columns as text: casting is the cleaner's work, not the reader's."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])
