"""Names given to the classes that the queries sort rows into."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Labels:
    """One language's class names. Segments and bands run from the first rule to the last."""

    segments: tuple[str, str, str, str]
    bands: tuple[str, str, str, str]
    seller_pays: str
    buyer_pays: str
    unknown_payer: str
    mutual: str
    below_market: str
    above_market: str
    at_market: str
    buyer: str
    seller: str


ENGLISH = Labels(
    segments=("VIP", "High", "Medium", "Low"),
    bands=("Small", "Medium", "Large", "Very large"),
    seller_pays="seller_pays",
    buyer_pays="buyer_pays",
    unknown_payer="unknown",
    mutual="mutual",
    below_market="below_market",
    above_market="above_market",
    at_market="at_market",
    buyer="buyer",
    seller="seller",
)

# The Spanish names shown to dashboard users.
SPANISH = Labels(
    segments=(
        "VIP (Top 20%)",
        "Alto Valor (50-80%)",
        "Valor Medio (20-50%)",
        "Bajo Valor (Inferior 20%)",
    ),
    bands=(
        "Pequeña (< $1M)",
        "Mediana ($1M-$10M)",
        "Grande ($10M-$50M)",
        "Muy Grande (> $50M)",
    ),
    seller_pays="Vendedor Paga",
    buyer_pays="Comprador Paga",
    unknown_payer="Desconocido",
    mutual="Mutua",
    below_market="Por Debajo del Mercado",
    above_market="Por Encima del Mercado",
    at_market="En el Mercado",
    buyer="Comprador",
    seller="Vendedor",
)

# Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKDAYS_SPANISH = (
    "Lunes",
    "Martes",
    "Miércoles",
    "Jueves",
    "Viernes",
    "Sábado",
    "Domingo",
)
