"""Recognising ledger versions, converting between them, and rule-based labels."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import month_from_parts, month_of, strip

# Columns that mark the daily ledger when its version is detected.
_V4_REQUIRED = {"Fecha", "Producto_id", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior"}
_V4_OPTIONAL = {
    "Año", "Mes", "Dia", "Producto_nombre", "Empresa_cliente", "Departamento_cliente", "Canal_venta", "Punto_venta",
    "Precio_unitario", "Descuento_pct", "Valor_total", "Costo_unitario", "Campana",
}
@dataclass(frozen=True)
class _Layout:
    """A ledger layout that a header may follow, and how far it does."""

    version: str
    fits: bool
    confidence: float
    missing: set[str]
    extra: set[str]


def detect_version(columns: list[str]) -> dict:
    """Version of a ledger from its column names alone: the first layout, from sure to likely, that they fit."""
    have = set(columns)
    optional = len(_V4_OPTIONAL & have) / len(_V4_OPTIONAL)
    no_v4, no_old = _V4_REQUIRED - have, set(S.LEGACY_REQUIRED) - have
    beyond_v4 = have - _V4_REQUIRED - _V4_OPTIONAL
    layouts = (
        _Layout("unknown", not have, 0.0, set(), set()),
        _Layout("v4", not no_v4 and optional > 0.3, 0.95, no_v4, beyond_v4),
        _Layout("legacy", not no_old, 0.95, no_old, set()),
        _Layout("v4", optional > 0.2, 0.5, no_v4, beyond_v4),
        _Layout("legacy", True, 0.5, no_old, have - set(S.LEGACY_REQUIRED)),
    )
    best = next(x for x in layouts if x.fits)
    return {
        "is_v4": best.version == "v4", "version": best.version, "confidence": best.confidence,
        "missing_columns": sorted(best.missing), "extra_columns": sorted(best.extra),
    }


def detect_format(columns: list[str]) -> str:
    """``v4`` where all columns that every daily ledger has are there, ``legacy`` where one is that only the older has."""
    have = {c.strip().lower() for c in columns}
    lower = lambda names: {n.lower() for n in names}
    if lower(_V4_REQUIRED) <= have:
        return "v4"
    if have & (lower(S.LEGACY_COLUMNS) - lower(S.LEDGER_COLUMNS)):
        return "legacy"
    raise ValueError(f"unknown ledger format: {columns}")


def common_format(column_lists: list[list[str]]) -> str:
    """The one format of a batch of files; mixed batches are refused."""
    formats = {detect_format(c) for c in column_lists}
    if len(formats) != 1:
        raise ValueError(f"files of mixed formats {sorted(formats)}")
    return formats.pop()


def column_names(is_v4: bool) -> dict[str, str]:
    return {
        "product": "Producto_id" if is_v4 else "Codigo", "date": "Fecha", "quantity": "Cantidad", "period": "Mes",
        "year": "Año", "stock": "Stock_posterior" if is_v4 else "Saldo_unid",
    }


def demand_to_legacy(demand: DataFrame) -> DataFrame:
    """(Producto_id, Año, Mes, Cantidad_total) to (Codigo, Mes as date, Demanda_Unid); converted tables pass through."""
    out = demand.withColumnsRenamed({"Producto_id": "Codigo", "Cantidad_total": "Demanda_Unid"})
    if dict(out.dtypes).get("Mes") in ("date", "timestamp"):
        return out
    return out.withColumn("Mes", month_from_parts("Año", "Mes")).withColumn("Codigo", strip("Codigo")).select("Codigo", "Mes", "Demanda_Unid")


def movements_to_legacy(movements: DataFrame) -> DataFrame:
    """Daily ledger headers to the older ones: code, document, units out, empty number and warehouse."""
    cols = movements.columns
    if {"Codigo", "Documento", "Salida_unid"} <= set(cols):
        return movements
    out = movements.withColumnsRenamed({"Producto_id": "Codigo", "Tipo_movimiento": "Documento", "Cantidad": "Cantidad_reg"})
    if "Salida_unid" not in cols:
        out = out.withColumn(
            "Salida_unid", F.when(F.col("Documento") == S.SALE_LABEL, F.abs("Cantidad_reg")).otherwise(F.lit(0.0))
        )
    out = out.withColumn("Codigo", strip("Codigo"))
    for c in ("Numero", "Bodega"):
        if c not in cols:
            out = out.withColumn(c, F.lit(""))
    return out


def stock_measure(columns: list[str]) -> str | None:
    """The name a stock table gives to its measure."""
    return next((c for c in S.STOCK_MEASURES if c in columns), None)


def stock_to_legacy(stock: DataFrame) -> DataFrame:
    """(Producto_id, Año, Mes, <measure>) to (Codigo, Mes as date, Saldo_unid)."""
    measure = stock_measure(stock.columns)
    if measure is None:
        raise ValueError(f"no stock measure among {stock.columns}")
    out = stock.withColumnsRenamed({"Producto_id": "Codigo", measure: "Saldo_unid"})
    if dict(out.dtypes).get("Mes") in ("date", "timestamp"):
        return out
    return out.withColumn("Mes", month_from_parts("Año", "Mes")).withColumn("Codigo", strip("Codigo")).select("Codigo", "Mes", "Saldo_unid")


def ledger_transform(df: DataFrame) -> DataFrame:
    """Movements with units in and out, the month as a date, and columns in report order."""
    out = df.withColumns(
        {
            "product_id": strip("product_id"),
            "out_units": F.when(F.col("kind") == S.SALE, F.abs("qty")).otherwise(F.lit(0.0)),
            "in_units": F.when(F.col("kind") == S.PRODUCTION, F.abs("qty")).otherwise(F.lit(0.0)),
            "month": month_of("date"),
        }
    )
    order = [
        "date", "year", "month_no", "month", "day", "product_id", "product_name", "kind", "qty", "out_units", "in_units",
        "stock_before", "stock_after", "client", "department", "channel", "pos", "unit_price", "discount_pct", "total_value",
        "campaign", "unit_cost",
    ]
    return out.select(*[c for c in order if c in out.columns])


def _mapped(c: Column, pairs: dict[str, str | None]) -> Column:
    table = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v).cast("string")) for k, v in pairs.items()))
    return F.try_element_at(table, c)


def label(c: str, pairs: dict[str, str | None]) -> Column:
    """Code to label by exact match; null for unknown codes."""
    return F.when(F.col(c).isNotNull(), _mapped(F.col(c), pairs))


def channel_by_text(document: str) -> Column:
    """Channel from words in the document label; entries are not sales."""
    d = F.col(document)
    return (
        F.when(d.contains("Entrada"), F.lit(None).cast("string"))
        .when(d.contains("Salida por Consumo") | d.contains("Venta Tienda"), "Tienda Física")
        .when(d.contains("Guia de remision"), "Online")
    )


def department_by_text(warehouse: str) -> Column:
    """Department of a warehouse where the rules fix one; null for those that they leave to chance."""
    return F.when(F.col(warehouse).contains("Central"), F.lit("Lima"))


def product_type(name: str) -> Column:
    """Type from words in the description; the first rule that matches wins."""
    text = F.lower(F.col(name))
    out = F.lit(S.OTHER_TYPE)
    for words, kind in reversed(S.TYPE_KEYWORDS):
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def price_bands(df: DataFrame, bands: dict[str, tuple[float, float, float, float]], *, kind: str, cost: str, price: str) -> DataFrame:
    """Cost and price against the band of their type; unknown types use the last band.

    A price must also reach the margin floor over cost.
    """
    other = list(bands)[-1]
    parts = []
    for i in range(4):
        values = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(b[i])) for k, b in bands.items()))
        parts.append(F.coalesce(F.try_element_at(values, F.col(kind)), F.lit(bands[other][i])))
    cost_min, cost_max, price_min, price_max = parts
    floor = F.greatest(price_min, F.col(cost) * S.MARGIN_FLOOR)
    return df.withColumn("cost_outside", ~F.col(cost).between(cost_min, cost_max)).withColumn(
        "price_outside", (F.col(price) < floor) | (F.col(price) > price_max)
    )


def discount_tier(discount: str) -> Column:
    d = F.col(discount)
    return F.when(d >= 6, "alto").when(d >= 3, "medio").otherwise("bajo")
