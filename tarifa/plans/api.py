"""The catalog's answers by endpoint: parameters read from texts and checked, rows as a DataFrame, and what is said about them.

A request is a mapping of texts, as a query string gives it. What it lacks or has wrong is collected by parameter in
InvalidQuery. Totals are counts where rows come from a table, and the page's own length where a search function made the page.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.plans import catalog as C
from tarifa.plans.compare import rank_page
from tarifa.plans.reports import coverage_summary, source_stats, sources_overview

MAX_PAGE = 50


class InvalidQuery(ValueError):
    """Parameters that can't be read: what is wrong, by name."""

    def __init__(self, issues: dict[str, str]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in issues.items()))
        self.issues = issues


@dataclass
class Answer:
    rows: DataFrame
    page: int
    limit: int
    total: int
    filters: dict[str, str | bool] = field(default_factory=dict)

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total / self.limit)


class Request:
    """Reads parameters one by one and keeps what is wrong with them."""

    def __init__(self, params: dict[str, str]):
        self.params, self.issues = params, {}

    def text(self, name: str, most: int) -> str | None:
        value = self.params.get(name)
        if value is None:
            return None
        if not 1 <= len(value.strip()) <= most:
            self.issues[name] = f"1 to {most} characters"
        return value.strip()

    def number(self, name: str, low: float, high: float, default: float | None = None, whole: bool = False, above: bool = False) -> float | None:
        if name not in self.params:
            return default
        try:
            value = float(self.params[name].strip() or "0")
        except ValueError:
            value = math.nan
        if not (low < value if above else low <= value) or not value <= high or whole and value != int(value):
            self.issues[name] = f"a number from {low} to {high}"
            return default
        return int(value) if whole else value

    def choice(self, name: str, allowed: tuple[str, ...], default: str | None = None) -> str | None:
        value = self.params.get(name, default)
        if value is not None and value not in allowed:
            self.issues[name] = "one of " + ", ".join(allowed)
        return value

    def paging(self) -> tuple[int, int]:
        return self.number("page", 1, 10_000, 1, whole=True), self.number("limit", 1, MAX_PAGE, 20, whole=True)

    def check(self) -> None:
        if self.issues:
            raise InvalidQuery(self.issues)


@dataclass
class PriceQuery:
    page: int
    limit: int
    query: str | None
    store: str | None
    source: str | None
    available: str | None
    lat: float | None
    lng: float | None
    radius_km: float
    order_by: str

    @property
    def filters(self) -> dict[str, str | bool]:
        given = {"store": self.store, "source": self.source, "available": None if self.available is None else self.available == "true"}
        given |= {"lat": None if self.lat is None else str(self.lat), "lng": None if self.lng is None else str(self.lng)}
        return {k: v for k, v in given.items() if v is not None}


def price_query(params: dict[str, str], nearby: bool = False) -> PriceQuery:
    """A price request; nearby ones need a query and a place."""
    r = Request(params)
    page, limit = r.paging()
    q = PriceQuery(
        page, limit, r.text("query", 100), r.text("store", 100), r.text("source", 50), r.choice("available", ("true", "false")), r.number("lat", -90, 90), r.number("lng", -180, 180),
        r.number("radius_km", 0, 100, 10.0, above=True), r.choice("order_by", ("price", "distance"), "price"),
    )
    if ("lat" in params) != ("lng" in params):
        r.issues["lat"] = "lat and lng go together"
    if nearby and (q.query is None or q.lat is None or q.lng is None):
        r.issues.setdefault("lat", "a nearby search needs query, lat and lng")
    r.check()
    return q


def _table_page(rows: DataFrame, order: list[Column], q) -> tuple[DataFrame, int]:
    return C.paged(rows, order, q.limit, q.page), rows.count()


def _prices(t: C.Tables, as_of: datetime, q: PriceQuery, table: DataFrame) -> tuple[DataFrame, int | None]:
    """A page, and its total if it comes from a table."""
    available = q.available != "false"
    if q.lat is not None:
        if q.source or q.store:
            rows = C.nearby_prices_v2(t, as_of, q.lat, q.lng, q.radius_km, q.query, q.source, q.store, available, limit=100)
            order = [F.col("distance_km" if q.order_by == "distance" else "price").asc(), F.col("store_product_id").asc(), F.col("branch_id").asc()]
            return C.paged(rows, order, q.limit, q.page), None
        sort = "distance" if q.order_by == "distance" else "price_asc"
        return C.nearby_prices(t, as_of, q.lat, q.lng, q.radius_km, q.query, q.limit, q.page, None, available, sort), None
    if not (q.source or q.store):
        return C.online_prices(t, as_of, q.query, q.limit, q.page, None, available), None
    rows = table
    if q.query:
        rows = rows.filter(S.matches_search(q.query, F.col("normalized_name")))
    if q.store:
        rows = rows.filter(F.col("store_slug") == q.store)
    if q.source:
        rows = rows.filter(F.col("source") == q.source)
    if q.available:
        rows = rows.filter(F.col("available") == (q.available == "true"))
    return _table_page(rows, [F.col(c).asc_nulls_last() for c in ("price", "store_product_id", "branch_id")], q)


def prices(t: C.Tables, as_of: datetime, params: dict[str, str]) -> Answer:
    q = price_query(params)
    rows, total = _prices(t, as_of, q, C.latest_prices(t, as_of))
    return Answer(rows, q.page, q.limit, rows.count() if total is None else total, q.filters)


def compare(t: C.Tables, as_of: datetime, params: dict[str, str]) -> Answer:
    """Prices with rank and best price: over all of the same name, near a place over those of the page alone."""
    q = price_query(params)
    rows, total = _prices(t, as_of, q, C.compare_prices(t, as_of))
    if q.lat is not None:
        rows = rank_page(rows)
    return Answer(rows, q.page, q.limit, rows.count() if total is None else total, q.filters)


def nearby(t: C.Tables, as_of: datetime, params: dict[str, str]) -> Answer:
    q = price_query(params, nearby=True)
    rows, _ = _prices(t, as_of, q, C.latest_prices(t, as_of))
    return Answer(rows, q.page, q.limit, rows.count(), q.filters)


@dataclass
class _Paging:
    page: int
    limit: int


def _listed(rows: DataFrame, params: dict[str, str], searched: list[str], equal: dict[str, tuple[str, int]], order: list[str]) -> Answer:
    r = Request(params)
    q, query = _Paging(*r.paging()), r.text("query", 100)
    values = {name: r.text(name, most) for name, (_, most) in equal.items()}
    r.check()
    if query:
        rows = rows.filter(S.matches_search(query, *map(F.col, searched)))
    for name, value in values.items():
        rows = rows.filter(F.col(equal[name][0]) == value) if value else rows
    page, total = _table_page(rows, [F.col(c).asc_nulls_last() for c in order], q)
    return Answer(page, q.page, q.limit, total, {k: v for k, v in values.items() if v})


def stores(t: C.Tables, params: dict[str, str]) -> Answer:
    return _listed(t.stores.filter("enabled").select("id", "name", "slug", "country"), params, ["name"], {}, ["name", "id"])


def products(t: C.Tables, params: dict[str, str]) -> Answer:
    return _listed(t.products.select("id", "name", "normalized_name", "category"), params, ["normalized_name"], {"category": ("category", 100)}, ["name", "id"])


def branches(t: C.Tables, params: dict[str, str]) -> Answer:
    rows = t.branches.select("id", "store_id", "name", "address", "municipality", "latitude", "longitude", "geocoding_status", F.col("city_code").cast("string").alias("city_code"))
    return _listed(rows, params, ["name"], {"city_code": ("city_code", 20)}, ["name", "id", "store_id"])


def coverage(t: C.Tables) -> DataFrame:
    return coverage_summary(t)


def sources(t: C.Tables, catalog: DataFrame, as_of: datetime) -> DataFrame:
    return sources_overview(catalog, t, as_of)


def health(t: C.Tables, as_of: datetime) -> DataFrame:
    """By source: when it was last seen and how that is to be taken."""
    return source_stats(t).select("source", "latest_snapshot_at", S.source_health(F.col("latest_snapshot_at"), as_of).alias("health"))
