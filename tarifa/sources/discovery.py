"""Links to products on a shop's pages, each with why it isn't to be followed: what the page's embedded state says of the item decides.

Addresses and items are read page by page; links and items then meet by address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.sources.feeds import absent, at, flag, items, text
from tarifa.sources.markup import Carried
from tarifa.sources.retail import _claim, _objects

#: How a shop's state names the page of an item: by slug under a folder, or by a detail address.
SLUG, DETAIL = "slug", "detail"
FOUND = "page_id long, links array<string>, stated array<struct<address: string, claims: array<string>>>"


def _stated(data, named: str, folder: str) -> list[tuple[str, list[str]]]:
    """Address and claims of the items in a state. Under a detail address stand all objects in it with the item's id, availability and price."""
    out = []
    for o in _objects(data):
        if named == SLUG and isinstance(o.get("slug"), str) and isinstance(o.get("pricing"), dict) and o.get("__typename") == "Product":
            out.append((f"{folder}{o['slug']}", [json.dumps(_claim(o))]))
        elif named == DETAIL and isinstance(o.get("productDetailUrl"), str):
            own = [x for x in _objects(o) if x.get("id") == o.get("id") and {"isAvailable", "price"} <= x.keys()]
            out.append((o["productDetailUrl"], [json.dumps(_claim(x)) for x in own]))
    return out


def read_pages(pages: DataFrame, origin: str, named: str, folder: str) -> DataFrame:
    """FOUND of pages (page_id, html): absolute addresses of anchors in order, and what the state says of items, by absolute address."""

    def whole(address: str) -> str:
        try:
            return urljoin(f"{origin}/", address)
        except ValueError:
            return address

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                carried = Carried(html or "")
                rows.append((page_id, [whole(x) for x in carried.links], [(whole(a), c) for a, c in _stated(carried.state(), named, folder)]))
            yield pd.DataFrame(rows, columns=["page_id", "links", "stated"])

    return pages.select("page_id", "html").mapInPandas(read, FOUND)


def _why_not(claims: Column, named: str) -> Column:
    """Why an item with these claims (variants) is held back; null if it isn't."""
    if named == SLUG:
        fine = lambda c: F.coalesce(flag(at(c, "untaxed")), F.lit(False))
        plain = lambda c: absent(at(c, "before")) | F.coalesce(text(at(c, "before")) == "", F.lit(False))
        return F.when(~F.exists(claims, fine), "tax_inclusion_unknown").when(~F.exists(claims, lambda c: fine(c) & plain(c)), "promotion")
    kept = lambda c: F.coalesce(~flag(at(c, "sale")), F.lit(False))
    one = lambda c: (F.size(items(at(c, "pieces"))) == 1) & F.coalesce(flag(F.get(items(at(c, "pieces")), 0)), F.lit(False))
    return F.when(F.size(claims) == 0, "not_in_state").when(~F.forall(claims, kept), "promotion").when(~F.forall(claims, one), "weighted_or_ambiguous_unit")


def product_links(pages: DataFrame, origin: str, path: str, named: str = SLUG, folder: str = "/p/", listed_in_state: bool = False) -> DataFrame:
    """page_id, position (from 1), url and reason (null: to be followed) of the product links of pages (page_id, html), each address once, at its first place.

    A link must be of the origin, without query and fragment, and its path must match ``path`` as a whole; others are no product links. A link of which the state
    says nothing is not_in_state. With listed_in_state the addresses in the state are the links, and anchors aren't looked at.
    """
    found = read_pages(pages, origin, named, folder)
    source = F.transform("stated", lambda s: s["address"]) if listed_in_state else F.col("links")
    links = found.select("page_id", F.posexplode(source).alias("position", "url")).filter(F.col("url").rlike(f"^{_quoted(origin)}(?:{path})$"))
    links = links.groupBy("page_id", "url").agg((F.min("position") + 1).cast("long").alias("position"))
    stated = found.select("page_id", F.explode("stated").alias("s")).select(F.col("page_id").alias("_page"), F.col("s.address").alias("_url"), F.explode_outer("s.claims").alias("claim"))
    stated = stated.groupBy("_page", "_url").agg(F.collect_list("claim").alias("claims"))  # the claims of one item on one page
    both = links.join(stated, links["page_id"].eqNullSafe(stated["_page"]) & (links["url"] == stated["_url"]), "left")
    claims = F.transform("claims", lambda c: F.try_parse_json(c))
    reason = F.when(F.col("claims").isNull(), "not_in_state").otherwise(_why_not(claims, named))
    return both.select("page_id", "position", "url", reason.alias("reason"))


def _quoted(plain: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in plain)
