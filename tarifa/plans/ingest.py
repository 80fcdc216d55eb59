"""Validation of staged records and the preflight report. Records stay JSON; every rule is a Spark condition on them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa import constants as K
from tarifa.functions import scalars as S
from tarifa.operators.latest import first_by

# Fields of the staging format.
REQUIRED = ("source", "store_brand", "store_slug", "source_product_name", "normalized_name", "category", "presentation", "currency", "captured_at", "observed_at", "source_url", "evidence_kind", "store_product_url", "content_hash", "external_reference", "review_status")
BRANCH_TEXTS = ("branch_external_key", "branch_name", "branch_address", "branch_municipality", "branch_state")
BRANCH_FIELDS = (*BRANCH_TEXTS, "latitude", "longitude")
MIN_HASH = r"^[A-Za-z0-9:_-]{8,128}$"


class Record:
    """Fields of a JSON object (a variant): their kinds, texts and numbers."""

    def __init__(self, value: Column, read: Column | None = None, asked: set | None = None):
        self.value, self._read, self._asked = value, read, set() if asked is None else asked

    @staticmethod
    def read(raw: Column, use: Callable[[Record], Column]) -> Column:
        """What ``use`` makes of the record in a JSON text, which is parsed once, and each of its fields read once, however many rules look at it."""
        asked: set[tuple[str, str]] = set()
        use(Record(F.lit(None), None, asked))  # which fields it looks at
        found = lambda v: F.struct(v.alias("value"), *[Record(v)._take(*f).alias("_".join(f)) for f in sorted(asked)])
        fields = F.transform(F.array(F.try_parse_json(raw)), found)
        return F.get(F.transform(fields, lambda r: use(Record(r["value"], r))), F.lit(0))

    def _take(self, kind: str, name: str) -> Column:
        if self._read is not None:
            return self._read[f"{kind}_{name}"]
        self._asked.add((kind, name))
        return F.schema_of_variant(F.try_variant_get(self.value, f"$.{name}", "variant")) if kind == "kind" else F.try_variant_get(self.value, f"$.{name}", "string")

    def kind(self, name: str) -> Column:
        """The variant type of a field; null where it is missing."""
        return self._take("kind", name)

    def get(self, name: str, kind: str = "string") -> Column:
        return self._take("text", name) if kind == "string" else F.try_variant_get(self.value, f"$.{name}", kind)

    def text(self, name: str) -> Column:
        """A string field, else null."""
        return F.when(self.kind(name) == "STRING", self.get(name))

    def number(self, name: str) -> Column:
        return F.when(self.kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), self.get(name, "double"))

    def given(self, name: str) -> Column:
        """Whether there is anything but null or blank text."""
        return F.coalesce((self.kind(name) != "VOID") & (F.trim(F.coalesce(self.get(name), F.lit("x"))) != ""), F.lit(False))

    def filled(self, name: str) -> Column:
        return F.coalesce(F.trim(self.text(name)) != "", F.lit(False))


def _is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def record_issues(raw: Column, as_of: datetime) -> Column:
    """Codes of what is wrong with a staged record, in the order of the rules; empty if it may be staged."""
    return Record.read(raw, lambda r: _issues(r, as_of))


def _issues(r: Record, as_of: datetime) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    tests: list[tuple[Column, str]] = [(~r.filled(f), f"missing_{f}") for f in REQUIRED]
    price, confidence = r.number("price"), r.number("confidence_score")
    tests.append((~yes((price > 0) & (price < float("inf"))), "invalid_price"))
    tests.append((r.filled("currency") & ~yes(r.text("currency").rlike("^[A-Z]{3}$")), "invalid_currency"))
    tests.append((~yes(confidence.between(K.MIN_CONFIDENCE, 1)), "invalid_confidence_score"))
    is_false = (r.kind("is_synthetic") == "BOOLEAN") & ~r.get("is_synthetic", "boolean")
    tests.append((~yes(is_false), "synthetic_record"))
    tests.append((~yes(r.text("review_status") == "accepted"), "review_not_accepted"))
    tests.append((~yes(r.kind("available") == "BOOLEAN"), "invalid_available"))
    any_branch = F.lit(False)
    for f in BRANCH_FIELDS:
        any_branch = any_branch | r.given(f)
    scope = F.coalesce(r.get("price_scope"), F.when(any_branch, "branch_local").otherwise("online"))
    tests.append((~scope.isin("online", "branch_local"), "invalid_price_scope"))
    tests += [((scope == "online") & r.given(f), "online_has_branch_data") for f in BRANCH_FIELDS]
    local = scope == "branch_local"
    tests += [(local & ~r.filled(f), f"missing_{f}") for f in BRANCH_TEXTS]
    tests += [(local & ~yes(r.number(f).between(*box)), f"invalid_{f}") for f, box in (("latitude", K.LATITUDES), ("longitude", K.LONGITUDES))]
    tests += [(r.filled(f) & ~_is_http(r.text(f)), f"invalid_{f}") for f in ("source_url", "store_product_url")]
    image = r.kind("image_url")
    tests.append((yes((image != "VOID") & ((image != "STRING") | ((r.get("image_url") != "") & ~_is_http(r.get("image_url"))))), "invalid_image_url"))
    tests.append((r.filled("evidence_kind") & ~yes(r.text("evidence_kind").isin(*K.EVIDENCE_KINDS)), "unknown_evidence"))
    tests += [(r.filled(f) & S.parse_instant(r.text(f)).isNull(), f"invalid_{f}") for f in ("captured_at", "observed_at")]
    observed = F.try_to_timestamp(r.text("observed_at"))
    tests.append((yes(~S.in_catalog_window(observed, as_of)), "observation_not_current"))
    tests.append((~yes(r.text("currency") == K.CURRENCY), "non_mxn"))
    tests.append((~yes(r.kind("raw_payload").startswith("OBJECT")), "invalid_raw_payload"))
    upstream = r.kind("validation_errors")
    tests.append((yes((upstream != "VOID") & (~upstream.startswith("ARRAY") | (F.size(r.get("validation_errors", "array<variant>")) > 0))), "upstream_validation_errors"))
    tests.append((r.filled("content_hash") & ~yes(r.text("content_hash").rlike(MIN_HASH)), "invalid_content_hash"))
    depot = yes(r.text("source") == "home-depot-mx")
    tests.append((depot & ~yes(r.text("store_slug") == "home-depot-mx"), "invalid_home_depot_store_slug"))
    key = r.text("branch_external_key")
    tests.append((depot & yes((key != "") & ~key.rlike(r"^home-depot-mx:[0-9]+$")), "invalid_home_depot_branch_key"))
    codes = F.array(*[F.when(test, F.lit(code)) for test, code in tests])
    return F.filter(codes, lambda c: c.isNotNull())


def validated(lines: DataFrame, as_of: datetime) -> DataFrame:
    """lines of read_ndjson() with issues: what is wrong with the line or with its record."""
    issues = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(record_issues(F.col("raw"), as_of))
    return lines.withColumn("issues", issues)


def unique_records(checked: DataFrame) -> DataFrame:
    """Accepted lines, the first of each source and content hash."""
    good = checked.filter(F.size("issues") == 0)
    named = good.withColumn("source", S.json_text(F.col("raw"), "source")).withColumn("content_hash", S.json_text(F.col("raw"), "content_hash"))
    return first_by(named, ["source", "content_hash"], [F.col("file").asc(), F.col("line").asc()])


def preflight(checked: DataFrame) -> DataFrame:
    """One row: input, accepted, duplicates among the accepted, unique and rejected lines."""
    good = F.size("issues") == 0
    pair = F.struct(S.json_text(F.col("raw"), "source"), S.json_text(F.col("raw"), "content_hash"))
    out = checked.agg(F.count("*").alias("input"), F.count_if(good).alias("accepted"), F.count_distinct(F.when(good, pair)).alias("unique"))
    return out.select("input", "accepted", (F.col("accepted") - F.col("unique")).alias("duplicates"), "unique", (F.col("input") - F.col("accepted")).alias("rejected"))


def rejection_histogram(checked: DataFrame) -> DataFrame:
    """How often each code was given; the most frequent first, then by code."""
    # An inner explode is preceded by filters on its array, each of which would validate the lines once more.
    return checked.select(F.explode_outer("issues").alias("code")).filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code")


def preflight_groups(checked: DataFrame) -> DataFrame:
    """Accepted and rejected lines by source, branch and category; what is missing reads <missing>."""
    named = lambda name: F.coalesce(F.nullif(F.trim(S.json_text(F.col("raw"), name)), F.lit("")), F.lit("<missing>")).alias(name)
    good = F.size("issues") == 0
    rows = checked.filter("error IS NULL").select(named("source"), named("branch_external_key"), named("category"), good.alias("good"))
    return rows.groupBy("source", "branch_external_key", "category").agg(F.count("*").alias("records"), F.count_if("good").alias("accepted"), F.count_if(~F.col("good")).alias("rejected"))


def publishable(staged: DataFrame) -> DataFrame:
    """Staged rows that may become prices: accepted, proven, confident, without errors, and whole for their scope.

    staged: review_status, evidence_kind, confidence_score, is_synthetic, validation_errors, price_scope, latitude, longitude (texts), branch_external_key.
    """
    number = r"^-?[0-9]+(\.[0-9]+)?$"
    proven = (F.col("review_status") == "accepted") & F.col("evidence_kind").isin(*K.EVIDENCE_KINDS) & (F.col("confidence_score") >= K.MIN_CONFIDENCE) & ~F.col("is_synthetic")
    clean = F.size(F.coalesce("validation_errors", F.array().cast("array<string>"))) == 0
    # The text is tested before it is cast, in one expression, so what isn't a number never is.
    lat, lon = (F.when(F.col(c).rlike(number), F.col(c).try_cast("double")) for c in ("latitude", "longitude"))
    placed = ~S.blank(F.col("branch_external_key")) & S.in_mexico(lat, lon)
    return staged.filter(proven & clean & F.when(F.col("price_scope") == "online", S.blank(F.col("branch_external_key"))).otherwise((F.col("price_scope") == "branch_local") & placed))
