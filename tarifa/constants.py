"""Fixed values of the price-observation domain."""

CURRENCY = "MXN"
COUNTRY = "MX"
FRESH_DAYS, STALE_DAYS = 7, 21
FUTURE_MINUTES = 5
RETENTION_DAYS = 90
EARTH_KM = 6371.0
LATITUDES, LONGITUDES = (14, 33.5), (-119, -86)
URL = r"^https?://[^ /]+"
MIN_CONFIDENCE = 0.70
IMPLAUSIBLE_PRICE = 100_000
GEOCODED = ("manual", "geocoded")
EVIDENCE_KINDS = ("product_page", "store_api", "official_feed", "sitemap", "manual_review")
SORTS = ("price_asc", "price_desc", "fresh_desc", "name", "distance")
