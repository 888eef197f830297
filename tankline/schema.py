"""Column-name contract for transaction tables.

Operators take a ``TxnCols`` so the same code runs on the fixture view
(``txn_id``, ``entity_id`` ...) and on a user's own column names.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TxnCols:
    id: str = "txn_id"
    entity: str = "entity_id"
    ts: str = "ts"
    amount: str = "amount_cents"
    litres: str = "litres"
    category: str = "category"
    district: str = "district"
    site: str = "site"
    department: str = "department"
    fuel: str = "fuel_type"
    unit_price: str = "unit_price"
    coastal_petrol: str = "coastal_petrol_cents"
    coastal_diesel: str = "coastal_diesel_cents"
    inland_petrol: str = "inland_petrol_cents"
    inland_diesel: str = "inland_diesel_cents"


DEFAULT = TxnCols()
