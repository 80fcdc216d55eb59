"""Which offers are the same product: identifiers decide, and texts only where nothing contradicts them.

For two offers, in this order: packs that are known and differ part them; two GTINs match if equal and part them if not; an invalid GTIN, or GTINs of
one offer that differ, leave only that; the same listing of a retailer matches; and so do equal brand, pack and name without measures.

The relation isn't transitive, so matches are links, not groups. Whatever an offer can match has a key in common with it, and within a key what
counts is the pack and whether there is a GTIN. So links are counted from sums by key, pack and GTIN; no pairs are built for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.functions import scalars as S
from tarifa.functions import text as T

CODES = ("gtin", "ean", "upc")


def signatures(offers: DataFrame) -> DataFrame:
    """What matching looks at, of offers (offer_id, retailer, external_id, brand, name, presentation and any of gtin, ean, upc): canonical gtin, whether the
    codes are at fault, pack, and variant (the name without measures, lower-cased and folded; null if nothing is left)."""
    given = [F.col(c) for c in CODES if c in offers.columns]
    codes = F.filter(F.array(*given).cast("array<string>"), lambda c: c.isNotNull())
    valid = F.array_distinct(F.array_compact(F.transform(codes, lambda c: S.canonical_gtin(c))))
    pack = T.presentation_key(T.parse_presentation(F.coalesce(F.nullif("presentation", F.lit("")), "name")))
    rows = offers.select("offer_id", "retailer", "external_id", "brand", "name", pack.alias("pack"), codes.alias("codes"), valid.alias("valid"))
    fault = (F.size("valid") > 1) | F.exists("codes", lambda c: S.canonical_gtin(c).isNull())
    brand, variant = (F.nullif(T.normalize_compatible(x), F.lit("")) for x in (F.col("brand"), T.without_measures(F.col("name"))))
    return rows.select("offer_id", "retailer", "external_id", F.when(F.size("valid") == 1, F.col("valid")[0]).alias("gtin"), fault.alias("fault"), "pack", brand.alias("brand"), variant.alias("variant"))


def _sums(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """By keys: the number of rows with a GTIN and without one. Pre-summed within tasks, so a common key is no group in memory."""
    has = F.col("gtin").isNotNull()
    return rows.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.count_if(has).alias(f"{name}_with"), F.count_if(~has).alias(f"{name}_without"))


def _joined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(sums, [rows[k] == sums[f"k_{k}"] for k in keys], "left").drop(*[f"k_{k}" for k in keys])


def offer_links(offers: DataFrame) -> DataFrame:
    """offer_id with the number of other offers that it matches by GTIN, by retailer and external id, and by brand, variant and presentation."""
    s = signatures(offers).withColumn("p", F.coalesce("pack", F.lit("")))
    sure = s.filter("NOT fault")
    number = lambda c: F.coalesce(c, F.lit(0))
    own = F.col("gtin").isNotNull()

    def compatible(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        """rows with sums over keys of the rows whose pack doesn't contradict theirs: all for an unknown pack, else the same and unknown ones."""
        out = _joined(rows, _sums(of, keys, "all"), keys)
        out = _joined(out, _sums(of, [*keys, "p"], "same"), [*keys, "p"])
        out = _joined(out, _sums(of.filter("pack IS NULL"), keys, "none"), keys)
        pick = lambda kind: F.when(F.col("pack").isNull(), number(f"all_{kind}")).otherwise(number(f"same_{kind}") + number(f"none_{kind}"))
        return out.withColumns({"with": pick("with"), "without": pick("without")}).drop(*[f"{n}_{k}" for n in ("all", "same", "none") for k in ("with", "without")])

    found = compatible(s, s.filter(own), ["gtin"]).withColumn("gtin_links", F.when(own, F.col("with") - 1).otherwise(0)).drop("with", "without")
    # Where no two GTINs decide: any with none, itself left out.
    texts = lambda: F.when(F.col("fault"), 0).when(own, F.col("without")).otherwise(F.col("with") + F.col("without") - 1)
    listing = F.col("retailer").isNotNull() & F.col("external_id").isNotNull()
    found = compatible(found, sure.filter(listing), ["retailer", "external_id"]).withColumn("external_links", F.when(listing, texts()).otherwise(0)).drop("with", "without")
    whole, names = F.col("pack").isNotNull() & F.col("brand").isNotNull() & F.col("variant").isNotNull(), ["brand", "variant", "pack"]
    found = _joined(found, _sums(sure.filter(whole), names, "x"), names).withColumns({"with": number("x_with"), "without": number("x_without")})
    found = found.withColumn("variant_links", F.when(whole, texts()).otherwise(0)).drop("with", "without", "x_with", "x_without")
    # Those of the same listing match by that already.
    same = [*names, "retailer", "external_id"]
    found = _joined(found, _sums(sure.filter(whole & listing), same, "x"), same).withColumns({"with": number("x_with"), "without": number("x_without")})
    found = found.withColumn("variant_links", F.col("variant_links") - F.when(whole & listing, texts()).otherwise(0))
    return found.select("offer_id", *[F.col(c).cast("long").alias(c) for c in ("gtin_links", "external_links", "variant_links")])


def rule_of(left: str = "l", right: str = "r") -> Column:
    """The rule by which two signatures match, or null."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    equal = lambda *names: F.expr("true") if not names else (a(names[0]) == b(names[0])) & equal(*names[1:])
    parted = F.coalesce(a("pack") != b("pack"), F.lit(False))
    both = a("gtin").isNotNull() & b("gtin").isNotNull()
    by_text = F.when(equal("retailer", "external_id"), "retailer_external_id").when(equal("brand", "variant", "pack"), "brand_variant_presentation")
    return F.when(parted, None).when(both, F.when(equal("gtin"), "gtin")).when(a("fault") | b("fault"), None).otherwise(by_text)


def match_offers(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id and rule of all matches between two sets of offers, for a batch on the left: a common key gives a row for each match.

    Pairs are candidates if a GTIN, a listing, or brand, pack and variant are equal; those that the vetoes part are dropped before anything is moved again.
    """

    def keyed(offers: DataFrame, side: str) -> DataFrame:
        s = signatures(offers)
        key = lambda kind, *names: F.when(F.forall(F.array(*names), lambda x: x.isNotNull()), F.to_json(F.array(F.lit(kind), *names)))
        keys = F.array_compact(F.array(key("g", "gtin"), key("l", "retailer", "external_id"), key("v", "brand", "variant", "pack")))
        return s.select(F.struct(*s.columns).alias(side), F.explode(keys).alias("key"))

    pairs = keyed(left, "l").join(keyed(right, "r"), "key").withColumn("rule", rule_of())
    # A pair may meet in several keys, but only one of them is the rule's.
    own = F.when(F.col("rule") == "gtin", "g").when(F.col("rule") == "retailer_external_id", "l").otherwise("v")
    return pairs.filter(F.col("rule").isNotNull() & (F.substring("key", 3, 1) == own)).select(F.col("l.offer_id").alias("left_id"), F.col("r.offer_id").alias("right_id"), "rule")
