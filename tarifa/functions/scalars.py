"""Column functions of the domain: distance, age, identity codes, hashes, presentations. All keep null in, null out unless said otherwise."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifa import constants as K


def instant(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


# Geography


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = (F.radians((y - x) / 2) for x, y in ((lat1, lat2), (lon1, lon2)))
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return F.lit(2 * K.EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_mexico(lat: Column, lon: Column) -> Column:
    return lat.between(*K.LATITUDES) & lon.between(*K.LONGITUDES)


# Time


def days_old_calendar(captured: Column, as_of: datetime | Column) -> Column:
    """Days between the dates, at least 0."""
    return F.greatest(F.lit(0), F.datediff(instant(as_of), captured))


def days_old_elapsed(captured: Column, as_of: datetime | Column) -> Column:
    """Whole days that have passed, at least 0."""
    passed = F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(captured.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(passed / F.lit(86_400_000_000))).cast("int")


def freshness(days: Column) -> Column:
    """fresh below 7 days, stale to 21, else old."""
    return F.when(days < K.FRESH_DAYS, "fresh").when(days <= K.STALE_DAYS, "stale").when(days.isNotNull(), "old")


def source_health(latest: Column, as_of: datetime | Column) -> Column:
    days = days_old_elapsed(latest, as_of)
    return F.when(latest.isNull(), "no_data").when(days < K.FRESH_DAYS, "healthy").when(days <= K.STALE_DAYS, "stale").otherwise("old")


def coverage_freshness(latest: Column, as_of: datetime | Column) -> Column:
    """By intervals whose bounds belong to the fresher side."""
    since = lambda days: instant(as_of) - F.make_dt_interval(F.lit(days))
    return F.when(latest.isNull(), "no_data").when(latest >= since(K.FRESH_DAYS), "fresh").when(latest >= since(K.STALE_DAYS), "stale").otherwise("old")


def in_catalog_window(captured: Column, as_of: datetime | Column, days: int = K.FRESH_DAYS) -> Column:
    """Newer than days before as_of (that instant is out), and no more than five minutes after it."""
    now = instant(as_of)
    return (captured > now - F.make_dt_interval(F.lit(days))) & (captured <= now + F.make_dt_interval(mins=F.lit(K.FUTURE_MINUTES)))


def parse_instant(text: Column) -> Column:
    """A timestamp from text that names its offset (Z or ±hh:mm); else null."""
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text))


def parse_expiry(text: Column) -> Column:
    """Dates without a time end at the last second of the day at UTC-6."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T23:59:59-06:00")))).otherwise(parse_instant(text))


def noon_utc(day: Column) -> Column:
    return F.try_to_timestamp(F.concat(day, F.lit("T12:00:00Z")))


def capture_label(captured: Column) -> Column:
    return F.date_format(captured, "'Capturado' yyyy-MM-dd HH:mm 'UTC'")


# Tests of values


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def valid_url(url: Column) -> Column:
    """The url if it has a scheme and a host, else null."""
    return F.when(url.rlike(K.URL), url)


def first_url(*urls: Column) -> Column:
    return F.coalesce(*[valid_url(u) for u in urls])


def matches_search(query: str | None, *columns: Column) -> Column | None:
    """Whether any column contains the trimmed query, whatever the case; None for a blank query. % and _ keep their meaning."""
    if not query or not query.strip():
        return None
    found = F.lit(False)
    for c in columns:
        found = found | F.ilike(c, F.lit(f"%{query.strip()}%"))
    return found


def implausible(price: Column) -> Column:
    return (price <= 0) | (price > K.IMPLAUSIBLE_PRICE)


# Money and measures


def parse_money(text: Column) -> Column:
    """decimal(10,2) for a number with at most two decimals between 0 and 1,000,000 (both out), else null."""
    clean = F.when(text.rlike(r"^[0-9]{1,6}(\.[0-9]{1,2})?$"), text.try_cast("decimal(10,2)"))
    return F.when(clean > 0, clean)


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")


# Identity


def canonical_gtin(code: Column, reject_zeros: bool = True) -> Column:
    """The code padded to 14 digits if it has 8, 12, 13 or 14 digits and the right check digit, else null."""
    padded = F.lpad(code, 14, "0")
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda s, i: s + F.substring(padded, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    right = (10 - weighted % 10) % 10 == F.substring(padded, 14, 1).cast("int")
    shape = code.rlike(r"^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$")
    if reject_zeros:
        shape = shape & ~code.rlike("^0+$")
    return F.when(shape, F.when(right, padded))


def branch_key(source: Column, city: Column, store: Column, branch: Column) -> Column:
    """md5 over source, city (left out if null) and the lower-cased names."""
    return F.md5(F.concat_ws("|", source, city, F.lower(store), F.lower(branch)))


def collision_name(name: Column, slug: Column, url: Column) -> Column:
    return F.concat(name, F.lit(" ["), slug, F.lit(":"), F.md5(url), F.lit("]"))


def row_fingerprint(*columns: str) -> Column:
    """md5 of the columns as one JSON object; nulls are part of it."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def content_hash(*parts: Column) -> Column:
    """sha-256 of the parts as text, joined by bars; null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def identity_key(*parts: Column) -> Column:
    """Parts joined by bars; null reads null."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def evidence_url(*urls: Column) -> Column:
    """The first https or http URL with a host."""
    return F.coalesce(*[F.when(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull(), u) for u in urls])


def geocoding_query(*parts: Column) -> Column:
    """Non-blank parts joined by commas, at most 20 words and 256 characters."""
    text = F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ", ")
    return F.left(F.array_join(F.slice(F.split(text, r"\s+"), 1, 20), " "), F.lit(256))


def geocode_status(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, "geocoded").when(confidence.isNotNull(), "review")


# JSON


def json_text(payload: Column, key: str) -> Column:
    """A key of a JSON object as text (booleans as true and false); null for any other JSON."""
    return F.get_json_object(payload, f"$.{key}")


def has_key(payload: Column, key: str) -> Column:
    """Whether a JSON object has the key, be its value null; null for other JSON."""
    return F.array_contains(F.json_object_keys(payload), key)


def canonical_json(payload: Column) -> Column:
    """A JSON text with the keys of its objects in order and no spaces; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(payload))


def canonical_hash(payload: Column) -> Column:
    """sha-256 of the canonical form: the same for objects that differ in the order of keys alone."""
    return F.sha2(canonical_json(payload), 256)


def merged_json(left: Column, right: Column) -> Column:
    """Two JSON objects as one; where both have a key, the right one's value holds."""
    a, b = (F.from_json(x, "map<string,variant>") for x in (left, right))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def json_flag_is(payload: Column, key: str, value: str) -> Column:
    """Whether the key has this text; also where the key is missing."""
    return F.coalesce(json_text(payload, key), F.lit(value)) == value


def json_kind(payload: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null for what isn't JSON."""
    kind = F.schema_of_variant(F.try_parse_json(payload))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )
