"""Role mapping: which column plays which business role.

The mapping is plain driver-side metadata; it is never distributed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

# The 22 business roles (fixed values).
ROLE_NAMES = (
    "ship_mode", "ship_date", "date", "customer_id", "customer", "order_id",
    "subcategory", "category", "product", "region", "city", "state", "country",
    "segment", "cost", "unit_price", "margin_percent", "profit", "sales",
    "revenue", "quantity", "discount",
)


@dataclass(frozen=True)
class Roles:
    ship_mode: str | None = None
    ship_date: str | None = None
    date: str | None = None
    customer_id: str | None = None
    customer: str | None = None
    order_id: str | None = None
    subcategory: str | None = None
    category: str | None = None
    product: str | None = None
    region: str | None = None
    city: str | None = None
    state: str | None = None
    country: str | None = None
    segment: str | None = None
    cost: str | None = None
    unit_price: str | None = None
    margin_percent: str | None = None
    profit: str | None = None
    sales: str | None = None
    revenue: str | None = None
    quantity: str | None = None
    discount: str | None = None
    # metadata recorded by preparation (never a column)
    profit_estimated: bool = False
    notes: tuple = field(default_factory=tuple)

    def get(self, role: str) -> str | None:
        return getattr(self, role, None) if role in ROLE_NAMES else None

    def present(self, role: str, columns) -> str | None:
        c = self.get(role)
        return c if c and c in columns else None

    def customer_key(self) -> str | None:
        """Customer identity used by customer-grain operators (name, else id)."""
        return self.customer or self.customer_id

    def with_roles(self, **kw) -> "Roles":
        """Manual override (A22): set or clear roles (``None`` clears)."""
        unknown = set(kw) - set(ROLE_NAMES) - {"profit_estimated", "notes"}
        if unknown:
            raise ValueError(f"unknown roles: {sorted(unknown)}")
        return replace(self, **kw)

    def as_dict(self) -> dict[str, str]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if f.name in ROLE_NAMES and getattr(self, f.name)}


# Roles of the canonical test view (sources.testview.sales_fact) after preparation.
SALES_FACT_ROLES = Roles(
    ship_mode="ship_mode", ship_date="ship_date", date="order_date", customer_id="customer_id",
    customer="customer", order_id="order_id", subcategory="subcategory", category="category",
    product="product", region="region", state="state", segment="segment", cost="cost",
    unit_price="unit_price", profit="profit", sales="sales", quantity="quantity",
    discount="discount_pct",
)

# The analysis dimensions, in the order the reference walks them.
DIMENSIONS = ("category", "subcategory", "product", "region", "state", "city", "country",
              "segment", "customer", "ship_mode")


def plain(name: str) -> str:
    """Lower case, anything but letters, digits and % as one blank."""
    return re.sub("[^a-z0-9%]+", " ", name.lower()).strip()


def speaks_of(name: str, words) -> bool:
    """Does a column name contain one of the words?"""
    return any(plain(w) in plain(name) for w in words)
