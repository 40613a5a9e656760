"""Quantities in common units: parsing from text and properties, and units told by physical identities.

Parsing is built-in regular expressions and a small table of units, all inside the JVM. Where a table
holds the same things in several columns tied by a physical identity (mass = density x volume),
``units_by_identity`` finds the units under which the identity holds best.
"""

from __future__ import annotations

from itertools import product
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.runtime import checkpoint

#: Base unit, factor to it, and the spellings of each unit (lower case; plural and German forms included).
UNITS: tuple[tuple[str, float, str], ...] = (
    ("usd", 1.0, "usd|us$|u.s.$|$|dollars|dollar|u.s. dollars|u.s. dollar|us dollars|us dollar"),
    ("eur", 1.0, "eur|€|euros|euro"),
    ("bp", 100.0, "%|percent|per cent|pct|percentage points|percentage point|prozent"),
    ("bp", 10000.0, "fraction|ratio"),
    ("bp", 1.0, "basis points|basis point|bps|bp"),
    ("kg", 1.0, "kg|kgs|kilograms|kilogram|kilogrammes|kilogramm"),
    ("kg", 0.001, "g|grams|gram|gramm"),
    ("kg", 1000.0, "t|tonnes|tonne|metric tons|metric ton|metric_ton|tons|ton|tonnen"),
    ("kg", 907.18474, "short tons|short ton|short_ton|short_tons"),
    ("kg", 0.45359237, "lb|lbs|lbs.|pounds|pound|pfund"),
    ("kg", 0.028349523125, "oz|ounces|ounce"),
    ("m", 1.0, "m|meters|meter|metres|metre"),
    ("m", 1000.0, "km|kilometers|kilometer|kilometres|kilometre"),
    ("m", 0.01, "cm|centimeters|centimetres"),
    ("m", 0.3048, "ft|ft.|feet|foot|fuß"),
    ("m", 0.9144, "yd|yards|yard"),
    ("m", 1609.344, "mi|mi.|miles|mile|meilen|meile"),
    ("m2", 1.0, "m2|m²|sq m|sq. m|sqm|square meters|square meter|square metres|square metre|quadratmeter"),
    ("m2", 1000000.0, "km2|km²|sq km|sq. km|sqkm|square kilometers|square kilometer|square kilometres|square kilometre|quadratkilometer"),
    ("m2", 10000.0, "ha|hectares|hectare|hektar"),
    ("m2", 4046.8564224, "ac|acres|acre"),
    ("m2", 0.09290304, "sqft|sq ft|sq. ft.|sq. ft|sq ft.|square feet|square foot|ft2|ft²|quadratfuß"),
    ("m2", 2589988.110336, "sq mi|square miles|square mile|mi2"),
    ("l", 1.0, "l|liters|liter|litres|litre"),
    ("l", 1000.0, "m3|m³|cubic meters|cubic meter|cubic metres|cubic metre|cu m|cbm|kubikmeter"),
    ("l", 3.785411784, "gal|gal.|gallons|gallon|us gallons|us gallon|u.s. gallons|us-gallonen|gallonen"),
    ("l", 158.987294928, "bbl|bbls|barrels|barrel"),
    ("l", 28.316846592, "cubic feet|cubic foot|cu ft|ft3"),
    ("kwh", 1.0, "kwh|kilowatt-hours|kilowatt-hour|kilowatt hours|kilowattstunden"),
    ("kwh", 1000.0, "mwh|megawatt-hours|megawatt-hour|megawatt hours|megawattstunden"),
    ("kwh", 1000000.0, "gwh|gigawatt-hours|gigawatt-hour|gigawatt hours|gigawattstunden"),
    ("kwh", 1000.0 / 3.6, "gj|gigajoules|gigajoule"),
    ("kwh", 1.0 / 3.6, "mj|megajoules|megajoule"),
)
#: What scales are called, and number words.
SCALES: tuple[tuple[float, str], ...] = (
    (1.0, "|units|ones"),
    (1e3, "k|thousand|thousands|in thousands|(in thousands)|$ in thousands|000s|$000s|tsd"),
    (1e6, "m|mm|mn|mln|million|millions|in millions|(in millions)|$ in millions|mio"),
    (1e9, "b|bn|bln|billion|billions|in billions|(in billions)|$ in billions|mrd"),
    (1e12, "tn|trillion|trillions"),
)
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

_ALIASES = {a: (base, factor) for base, factor, names in UNITS for a in names.split("|")}
_SCALE = {a: s for s, names in SCALES for a in names.split("|")}
_WORDS = {w: float(n) for n, w in enumerate(_ONES, 1)} | {w: 10.0 * n for n, w in enumerate(_TENS, 2)}
#: Spellings that mean nothing behind a number in running text, or stand before it.
_NOT_IN_TEXT = {"$", "us$", "u.s.$", "€", "g", "pct", "fraction", "ratio", "usd", "eur", "%"}


def _any(words) -> str:
    return "|".join(w.replace(".", "\\.").replace("$", "\\$") for w in sorted(words, key=lambda w: (-len(w), w)))


_CURRENCY = r"US\$|U\.S\.\$|USD|EUR|\$|€"
_NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_NUMBER_WORDS = rf"(?:{_any(_WORDS)})(?:[ -](?:{_any(_WORDS)}))?"
_BIG = "thousand|million|billion|trillion"
_IN_TEXT = _any({a for a in _ALIASES if a not in _NOT_IN_TEXT and "_" not in a})
#: A currency sign or code before a number, or a number before a unit; scales between them; signs and brackets around.
_QUANTITY = (
    rf"(?i)(?<![\w.,$€])\(?(?:[-−–]\s?)?(?:(?:{_CURRENCY})\s?\(?(?:[-−–]\s?)?{_NUMBER}(?:\s?(?:{_BIG}|mm|bn|mln|[kmb])(?![\w]))?"
    rf"|(?:{_NUMBER}|\b{_NUMBER_WORDS})\s?(?:(?:{_BIG})\s)?(?:%|(?:{_IN_TEXT}|USD|EUR|€)(?![\w²³$])))\)?"
)


def _lookup(values: dict[str, float | str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def to_base(number: Column, unit: Column, scale: Column | None = None) -> tuple[Column, Column]:
    """(base unit, value in it rounded half away from zero to a whole bigint) of a number, a unit and a scale in any spelling; null where the unit is unknown."""
    unit = F.lower(F.trim(unit))
    factor = _lookup({a: f for a, (_, f) in _ALIASES.items()}, unit)
    times = F.lit(1.0) if scale is None else _lookup(_SCALE, F.lower(F.trim(F.coalesce(scale, F.lit("")))))
    exact = F.when(factor == 1, number * times).otherwise(number * times * factor)
    # Products such as 1.005 * 100 miss their tie by the last bits of a double, so six decimals are settled first.
    value = F.round(F.round(exact, 6)).cast("bigint")
    return _lookup({a: b for a, (b, _) in _ALIASES.items()}, unit), F.when(factor.isNotNull() & times.isNotNull(), value)


def _number(text: Column) -> Column:
    """A number with thousands commas, brackets or a minus sign, or with an exponent; null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"[,\s]", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.rlike("^[-−–]")
    digits = F.regexp_extract(bare, r"^[(]?[-−–+]?\$?(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[)]?$", 1)
    value = F.nullif(digits, F.lit("")).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def matches(text: Column) -> Column:
    """All quantities of a text as they are written."""
    return F.regexp_extract_all(text, F.lit(_QUANTITY), F.lit(0))


def parse_match(m: Column) -> tuple[Column, Column]:
    """(base unit, value) of one of ``matches``. A bracket around an amount of money makes it negative."""
    low = F.lower(m)
    prefix = F.regexp_extract(m, rf"(?i)^[(\s−–-]*({_CURRENCY})\s?\(?[−–-]?\s?\d", 1)
    suffix = F.regexp_extract(low, rf"(%|{_any(a for a in _ALIASES if a not in ('$', 'us$', 'u.s.$', '%') and '_' not in a)})\)?$", 1)
    unit = F.when(prefix != "", prefix).otherwise(suffix)
    digits = F.regexp_extract(m, _NUMBER, 0)
    words = F.split(F.regexp_extract(low, rf"^\W*({_NUMBER_WORDS})", 1), "[ -]")
    spoken = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(_lookup(_WORDS, w), F.lit(0.0)))
    value = F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("double")).otherwise(spoken)
    big = F.regexp_extract(low, rf"({_BIG})", 1)
    short = F.when(prefix != "", F.regexp_extract(low, r"\d\s?(mm|bn|mln|[kmb])\)?$", 1)).otherwise(F.lit(""))
    negative = m.rlike(r"^\(?[−–-]") | m.rlike(rf"(?i)^\(?(?:{_CURRENCY})\s?\(?[−–-]") | (m.rlike(r"\)$") & m.rlike(rf"(?i)^(?:\(|(?:{_CURRENCY})\s?\()") & (prefix != ""))
    return to_base(F.when(negative, -value).otherwise(value), unit, F.when(big != "", big).otherwise(short))


def text_quantities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base_unit, base_value): the distinct quantities of each id's texts. Null and empty texts give none."""
    found = df.select(F.col(id_col).alias("id"), F.explode(matches(F.col(text_col))).alias("m")).distinct()
    base, value = parse_match(F.col("m"))
    return found.select("id", base.alias("base_unit"), value.alias("base_value")).filter("base_unit IS NOT NULL AND base_value IS NOT NULL").distinct()


def property_quantities(df: DataFrame, id_col: str, map_col: str, text_keys: tuple[str, ...] = ("raw", "text", "span")) -> DataFrame:
    """(id, base_unit, base_value): the distinct quantities of property maps.

    A property may hold a written quantity (``text_keys``; with locale "de", or any other that writes a decimal comma,
    points and commas change places), or a number under ``value`` or ``amount`` whose unit is in ``unit``, ``uom`` or ``currency`` and whose
    scale is in ``scale`` or ``units``, or the key itself may name the unit (``value_kg``, ``value_usd_mm``, ``pct``).
    Null and empty maps, numbers without a unit and unknown units give nothing.
    """
    p = F.col("p")
    get = lambda key: F.try_element_at(p, F.lit(key))
    blank = lambda c: F.when(F.trim(c) != "", c)
    rows = df.select(F.col(id_col).alias("id"), F.col(map_col).alias("p")).filter(F.size("p") > 0)
    comma = F.lower(F.coalesce(get("locale"), F.lit("en"))).rlike("^(de|fr|es|pt|nl|it)")
    written = F.explode(F.array(*[F.when(comma, F.translate(get(k), ".,", ",.")).otherwise(get(k)) for k in text_keys]))
    texts = text_quantities(rows.select("id", written.alias("text")).filter("text IS NOT NULL"), "id", "text")
    unit = F.coalesce(blank(get("unit")), blank(get("uom")), blank(get("currency")))
    scale = F.coalesce(blank(get("scale")), blank(get("units")))
    plain = F.struct(F.coalesce(blank(get("value")), blank(get("amount"))).alias("number"), unit.alias("unit"), scale.alias("scale"))
    keys = F.transform(
        F.filter(F.map_entries(p), lambda e: e["key"].rlike("^value_|^(pct|percent)$")),
        lambda e: F.struct(
            e["value"].alias("number"),
            F.regexp_replace(F.regexp_replace(e["key"], "^value_", ""), "_(k|mm|bn)$", "").alias("unit"),
            F.regexp_extract(e["key"], "_(k|mm|bn)$", 1).alias("scale"),
        ),
    )
    numbers = rows.select("id", F.explode(F.concat(F.array(plain), keys)).alias("q")).select("id", _number(F.col("q.number")).alias("n"), F.col("q.unit").alias("u"), F.col("q.scale").alias("s"))
    base, value = to_base(F.col("n"), F.col("u"), F.col("s"))
    told = numbers.select("id", base.alias("base_unit"), value.alias("base_value")).filter("base_unit IS NOT NULL AND base_value IS NOT NULL")
    return texts.union(told).distinct()


def restated_quantities(df: DataFrame, id_col: str, name_col: str, map_col: str, text_keys: tuple[str, ...] = ("raw", "text", "span"), number_keys: tuple[str, ...] = ("value", "amount")) -> DataFrame:
    """(id, base_unit, unit, factor, residual, unique): the unit of each number of a property map by the identity with the quantity that the row's name states.

    The name's quantity gives the dimension and the value in base units; number x factor = stated value is the identity, and the
    units of the dimension with their scales are the choices of ``units_by_identity``. A row whose name states no quantity, or whose map holds no number, gives nothing.
    """
    p = F.col("p")
    number = F.coalesce(*[_number(F.try_element_at(p, F.lit(k))) for k in number_keys], *[F.regexp_replace(F.regexp_extract(F.try_element_at(p, F.lit(k)), _NUMBER, 0), ",", "").try_cast("double") for k in text_keys])
    said = df.select(F.col(id_col).alias("id"), F.explode(matches(F.col(name_col))).alias("m"), F.col(map_col).alias("p"))
    base, stated = parse_match(F.col("m"))
    rows = said.select("id", base.alias("base_unit"), F.abs(stated).cast("double").alias("stated"), F.abs(number).alias("number")).filter("base_unit IS NOT NULL AND number IS NOT NULL").distinct()
    rows = checkpoint(rows)  # read once for each base unit
    out = None
    for kind in dict.fromkeys(b for b, _, _ in UNITS):
        choices = {names.split("|")[0]: f for b, f, names in UNITS if b == kind}
        scales = [(s, names.split("|")[1] if s > 1 else "") for s, names in SCALES]
        choices = {f"{scale} {unit}".strip(): f * s for unit, f in choices.items() for s, scale in scales}
        found = units_by_identity(rows.filter(F.col("base_unit") == kind), {"stated": (1, {kind: 1.0}), "number": (-1, choices)})
        factor = _lookup(choices, F.col("unit"))
        part = found.select("id", "base_unit", "number", F.col("identity_units")["number"].alias("unit"), F.col("identity_residual").alias("residual"), F.col("identity_unique").alias("unique"))
        part = part.filter("unit IS NOT NULL").withColumn("factor", factor)
        out = part if out is None else out.unionByName(part)
    return out.select("id", "base_unit", "unit", "factor", F.round(F.round(F.col("number") * F.col("factor"), 6)).cast("bigint").alias("base_value"), F.round("residual", 6).alias("residual"), "unique")


def units_by_identity(df: DataFrame, columns: dict[str, tuple[int, dict[str, float]]], tolerance: float = 0.05, apart: float = 0.02) -> DataFrame:
    """``df`` with ``identity_units`` (map column -> unit), ``identity_residual`` and ``identity_unique``.

    ``columns`` gives for each column its exponent in an identity whose product is 1 in base units, and its
    possible units with their factors: mass = density x volume is ``{"mass": (1, {...}), "density": (-1, {...}), "volume": (-1, {...})}``.
    The combination with the least absolute log residual is taken; it is not unique if another one
    comes within ``apart`` of it, and null if the residual is above ``tolerance`` or a value is null, 0, negative
    or not a number. Combinations are fixed by the arguments, so each row is decided by itself.
    """
    names = list(columns)
    combos = [(dict(zip(names, units, strict=True)), sum(columns[n][0] * log(columns[n][1][u]) for n, u in zip(names, units, strict=True))) for units in product(*(columns[n][1] for n in names))]
    usable = F.lit(True)
    total = F.lit(0.0)
    for n in names:
        c = F.col(f"`{n}`").cast("double")
        usable = usable & F.coalesce((c > 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False))
        total = total + columns[n][0] * F.ln(F.when(c > 0, c))
    shifts = F.array(*[F.lit(shift) for _, shift in combos])
    rows = df.withColumn("__t", F.when(usable, total))
    rows = rows.withColumn("__r", F.slice(F.array_sort(F.transform(shifts, lambda s, k: F.struct(F.abs(F.col("__t") + s).alias("r"), k.alias("k")))), 1, 2))
    first, second = F.try_element_at(F.col("__r"), F.lit(1)), F.try_element_at(F.col("__r"), F.lit(2))
    good = F.col("__t").isNotNull() & (first["r"] <= tolerance)
    chosen = F.create_map(*[x for n in names for x in (F.lit(n), F.element_at(F.array(*[F.lit(units[n]) for units, _ in combos]), first["k"] + 1))])
    return (
        rows.withColumn("identity_units", F.when(good, chosen))
        .withColumn("identity_residual", F.when(F.col("__t").isNotNull(), first["r"]))
        .withColumn("identity_unique", F.when(good, F.coalesce(second["r"] - first["r"] > apart, F.lit(True))))
        .drop("__r", "__t")
    )
