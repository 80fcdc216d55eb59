"""Text rules of the domain. There are several normalisers; they differ on purpose and aren't interchangeable."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks of Spanish, Portuguese and French text and what they fold to.
MARKED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold_marks(text: Column) -> Column:
    """Lower case, with marks off the letters above, inside the JVM."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def _spaced(text: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(text, f"[^{keep}]+", " "))


def normalize_name(text: Column) -> Column:
    """Folded; letters and digits only."""
    return _spaced(fold_marks(text), "a-z0-9")


def normalize_variant_text(text: Column) -> Column:
    """Folded; letters, digits and points."""
    return _spaced(fold_marks(text), "a-z0-9.")


# Spellings of units in official product names and their short forms, in the order of replacement.
OFFICIAL_UNITS = (("litros?|lts?|lt", "l"), ("mililitros?|mls?", "ml"), ("kilogramos?|kilos?|kgs?", "kg"), ("gramos?|grs?|gr", "g"), ("piezas?|pzas?|pza|pz", "pieza"))


def normalize_official_name(text: Column) -> Column:
    """Folded, units in short form, letters and digits only."""
    out = fold_marks(text)
    for spelling, short in OFFICIAL_UNITS:
        out = F.regexp_replace(out, rf"\b({spelling})\b", short)
    return _spaced(out, "a-z0-9")


def slug(text: Column) -> Column:
    return F.replace(normalize_official_name(text), F.lit(" "), F.lit("-"))


def fold_vowels(text: Column) -> Column:
    return F.translate(F.lower(text), "áéíóúü", "aeiouu")


def _per_value(rule: Callable[[str], str]) -> Callable[[Column], Column]:
    """A rule on Unicode forms that Spark has no function for, over Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else rule(v))

    return run


def _compatible(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9.,]+", text))


def _unmarked(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


# Spellings of units in retail names and the one they are compared by.
COMPARED_UNITS = {"gramos": "g", "gramo": "g", "grs": "g", "gr": "g", "kilogramos": "kg", "kilogramo": "kg", "kilos": "kg", "kilo": "kg", "litros": "l", "litro": "l", "lts": "l", "lt": "l", "mililitros": "ml", "mililitro": "ml", "mls": "ml", "piezas": "pza", "pieza": "pza", "pzas": "pza", "pz": "pza"}


def _comparable(text: str) -> str:
    words = [COMPARED_UNITS.get(w, w) for w in _compatible(html.unescape(html.unescape(text))).split()]
    return re.sub(r"(?<![a-z0-9])([0-9]+(?:[.,][0-9]+)?) (g|kg|l|ml|pza)(?![a-z0-9])", r"\1\2", " ".join(words))


def _fnv1a(text: str) -> str:
    """64-bit FNV-1a over UTF-8, as 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


#: Case folded, compatibility form without marks; letters, digits, points and commas.
normalize_compatible = _per_value(_compatible)
#: Lower case without combining marks, punctuation kept.
strip_marks = _per_value(_unmarked)
#: HTML unescaped twice, compatible form, units alike and glued to their number.
comparable_name = _per_value(_comparable)
stable_hash = _per_value(_fnv1a)
unescape_html = _per_value(html.unescape)


# Presentations

NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
# Spellings of units in presentations, the base unit, and how many of it.
BASE_UNITS = (
    ("kilogramos?|kilos?|kgs?", "g", 1000),
    ("mililitros?|mls?", "ml", 1),
    ("gramos?|grs?|gr|g", "g", 1),
    ("litros?|lts?|lt|l", "ml", 1000),
    ("rollos?", "rollo", 1),
    ("piezas?|pzas?|pza|pz|unidades|unidad", "unit", 1),
)
_UNIT = "|".join(u for u, _, _ in BASE_UNITS)


def _amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(18,6)")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: nested patterns would outgrow generated code."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def parse_presentation(text: Column) -> Column:
    """quantity, unit and pack_count of a presentation, in g, ml, rollo or unit; null if there is no measure.

    A multipack ``6 x 355 ml`` wins over a single measure; a pack without a count, or a count over 10,000, gives null.
    """
    packed = rf"(?<![0-9a-z.,])([0-9]{{1,5}})\s*(?:x|pack de|piezas? de|pzas? de)\s*{NUMBER}\s*({_UNIT})(?![a-z0-9])"
    single = rf"(?<![0-9a-z.,]){NUMBER}\s*({_UNIT})(?![a-z0-9])"

    def parts(t: Column) -> Column:
        part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
        amount = F.coalesce(_amount(part(packed, 2)), _amount(part(single, 1)))
        vague = t.rlike(r"\b(pack|paquete|multipack)\b")
        return F.struct(part(packed, 1).try_cast("int").alias("count"), amount.alias("amount"), F.coalesce(part(packed, 3), part(single, 2)).alias("spelled"), vague.alias("vague"))

    def measure(p: Column) -> Column:
        unit, factor = F.lit(None).cast("string"), F.lit(None).cast("int")
        for spelling, base, times in reversed(BASE_UNITS):
            is_it = p["spelled"].rlike(f"^({spelling})$")
            unit, factor = F.when(is_it, F.lit(base)).otherwise(unit), F.when(is_it, F.lit(times)).otherwise(factor)
        pack = F.coalesce(p["count"], F.lit(1))
        good = (p["amount"] > 0) & p["spelled"].isNotNull() & pack.between(1, 10_000) & (p["count"].isNotNull() | ~p["vague"])
        return F.when(good, F.struct((p["amount"] * factor).cast("decimal(18,6)").alias("quantity"), unit.alias("unit"), pack.alias("pack_count")))

    return _once(_once(fold_marks(text), parts), measure)


def without_measures(text: Column) -> Column:
    """A name without its multipacks and measures, marks folded."""
    measure = rf"{NUMBER}\s*(?:{_UNIT})(?![a-z0-9])"
    pack = rf"(?<![0-9a-z.,])[0-9]{{1,5}}\s*(?:(?:pack|paquete|piezas?|pzas?)\s*)?(?:x|de)\s*{measure}"
    return F.trim(F.regexp_replace(F.regexp_replace(fold_marks(text), pack, " "), rf"(?<![0-9a-z.,]){measure}", " "))


def written_measures(text: Column, units: tuple[str, ...]) -> Column:
    """The measures in a text as they are written, in order, each with the count of a pack that stands before it."""
    count = r"[0-9]+\s*(?:x|(?:piezas?\s*)?de)\s*"
    return F.regexp_extract_all(text, F.lit(rf"(?i)(?<![0-9a-z.,])((?:{count})?{NUMBER}\s*(?:{'|'.join(units)})(?![a-z0-9]))"), 1)


def measure_count(text: Column) -> Column:
    """How many measures a text states."""
    return F.regexp_count(fold_marks(text), F.lit(rf"(?<![0-9a-z.,]){NUMBER}\s*(?:{_UNIT})(?![a-z0-9])"))


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros or exponent."""
    text = value.cast("decimal(18,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def presentation_key(p: Column) -> Column:
    return F.concat(p["pack_count"].cast("string"), F.lit("x"), plain_number(p["quantity"]), p["unit"])


# Spellings of units in product names and their short forms.
VARIANT_UNITS = (("litros?|lts?|lt|l", "l"), ("mililitros?|ml", "ml"), ("kilogramos?|kilos?|kg", "kg"), ("gramos|grs?|gr|g", "g"))


def parse_variant(name: Column) -> Column:
    """label, quantity, unit, pack_count and key of a product name, as ``leche entera|qty=1l``."""
    t = normalize_variant_text(name)
    measure = r"(?<![a-z0-9.])([0-9]+(?:\.[0-9]+)?) ?(litros?|lts?|lt|l|mililitros?|ml|kilogramos?|kilos?|kg|gramos?|grs?|gr|g)(?=\s|$)"
    packs = r"(?<![a-z0-9.])([0-9]+) ?(?:rollos?|piezas?|pzas?|pack|paquetes?|latas?|sobres?)(?=\s|$)"
    quantity = F.nullif(F.regexp_extract(t, measure, 1), F.lit("")).try_cast("double")
    spelled = F.regexp_extract(t, measure, 2)
    unit = F.lit(None).cast("string")
    for spelling, short in VARIANT_UNITS:
        unit = F.when(spelled.rlike(f"^({spelling})$"), F.lit(short)).otherwise(unit)
    pack = F.nullif(F.regexp_extract(t, packs, 1), F.lit("")).try_cast("int")
    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, measure, " "), packs, " "), r"\s+", " "))
    number = F.regexp_replace(quantity.cast("string"), r"\.0$", "")
    key = F.concat_ws("|", label, F.when(quantity.isNotNull() & unit.isNotNull(), F.concat(F.lit("qty="), number, unit)), F.when(pack.isNotNull(), F.concat(F.lit("pack="), pack.cast("string"))))
    return F.struct(label.alias("label"), quantity.alias("quantity"), unit.alias("unit"), pack.alias("pack_count"), key.alias("key"))


# Spellings of units in names and what they are written as; pieces go by their number.
SHOWN_UNITS = (("kilos?|kg", "kg"), ("gramos?|gr|g", "g"), ("litros?|lt|l", "l"), ("ml", "ml"), ("piezas?|pzas|pz", "piezas"))


def infer_presentation(name: Column) -> Column:
    """A presentation out of a name: its first number with a unit, else ``1`` and a unit that stands alone, else ``1 pieza``."""
    spelled = "kg|kilos?|gramos?|gr|g|litros?|lt|l|ml|piezas|pieza|pzas|pz"
    alone = "kg|kilos?|litros?|lt|l|piezas|pieza|pzas|pz"
    with_number = rf"(?i)([0-9]+(?:[.,][0-9]+)?)\s*({spelled})\b"
    found = lambda pattern, k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    number = F.replace(found(with_number, 1), F.lit(","), F.lit("."))

    def shown(unit: Column, number: Column) -> Column:
        out = F.lower(unit)
        for spelling, short in SHOWN_UNITS:
            one = F.when(number.try_cast("double") == 1, "pieza").otherwise("piezas") if short == "piezas" else F.lit(short)
            out = F.when(F.lower(unit).rlike(f"^({spelling})$"), one).otherwise(out)
        return F.concat_ws(" ", number, out)

    lone = found(rf"(?i)\b({alone})\b", 1)
    return F.when(number.isNotNull(), shown(found(with_number, 2), number)).when(lone.isNotNull(), shown(lone, F.lit("1"))).otherwise("1 pieza")


def third_parts(text: Column) -> Column:
    """What follows the second comma, parts trimmed and joined again; null if nothing does."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.nullif(F.array_join(F.slice(parts, 3, 1000), ", "), F.lit(""))


def contains_all(text: Column, terms: Column) -> Column:
    """Whether the text contains every term of an array."""
    return F.forall(terms, lambda t: F.contains(text, t))


def demo_search(text: Column, query: str) -> Column:
    """Vowels folded, ``coca`` also found as ``cola``, all terms contained."""
    terms = [t for t in query.lower().translate(str.maketrans("áéíóúü", "aeiouu")).split() if t]
    folded = fold_vowels(text)
    out = F.lit(True)
    for t in terms:
        out = out & (F.contains(folded, F.lit(t)) | (F.contains(folded, F.lit("cola")) if t == "coca" else F.lit(False)))
    return out
