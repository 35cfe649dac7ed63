"""Normalisation of names, numbers and units, and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit, dimension, factor to the canonical unit of the dimension (V, A, W, VA, Wh, Ah, ohm, Hz, kg, mm,
#: litre, kPa, N m, L/min, s, degree Celsius, mm2), offset after it, and the names it goes by.
UNIT_NAMES = (
    ("v", "voltage", 1.0, 0.0, "v|volt|volts|vac|vdc"),
    ("mv", "voltage", 0.001, 0.0, "mv|millivolt|millivolts"),
    ("kv", "voltage", 1000.0, 0.0, "kv|kilovolt|kilovolts"),
    ("a", "current", 1.0, 0.0, "a|amp|amps|ampere|amperes"),
    ("ma", "current", 0.001, 0.0, "ma|milliamp|milliamps|milliampere|milliamperes"),
    ("ka", "current", 1000.0, 0.0, "ka|kiloamp|kiloamps"),
    ("w", "power", 1.0, 0.0, "w|watt|watts"),
    ("mw", "power", 0.001, 0.0, "mw|milliwatt|milliwatts"),
    ("kw", "power", 1000.0, 0.0, "kw|kilowatt|kilowatts"),
    ("va", "apparent_power", 1.0, 0.0, "va|volt-ampere|volt-amperes"),
    ("kva", "apparent_power", 1000.0, 0.0, "kva|kilovolt-ampere|kilovolt-amperes"),
    ("wh", "energy", 1.0, 0.0, "wh|watt-hour|watt-hours"),
    ("kwh", "energy", 1000.0, 0.0, "kwh|kilowatt-hour|kilowatt-hours"),
    ("ah", "capacity", 1.0, 0.0, "ah|amp-hour|amp-hours|ampere-hour|ampere-hours"),
    ("mah", "capacity", 0.001, 0.0, "mah|milliamp-hour|milliamp-hours"),
    ("ohm", "resistance", 1.0, 0.0, "ohm|ohms|ω"),
    ("mohm", "resistance", 0.001, 0.0, "mohm|mω|milliohm|milliohms"),
    ("kohm", "resistance", 1000.0, 0.0, "kohm|kω|kiloohm|kiloohms"),
    ("hz", "frequency", 1.0, 0.0, "hz|hertz"),
    ("khz", "frequency", 1000.0, 0.0, "khz|kilohertz"),
    ("kg", "mass", 1.0, 0.0, "kg|kilogram|kilograms"),
    ("g", "mass", 0.001, 0.0, "g|gram|grams"),
    ("oz_mass", "mass", 0.45359237 / 16, 0.0, "oz|oz_mass|ounce|ounces|oz mass"),
    ("lb", "mass", 0.45359237, 0.0, "lb|lbs|pound|pounds|lb_mass"),
    ("mm", "length", 1.0, 0.0, "mm|millimeter|millimeters"),
    ("cm", "length", 10.0, 0.0, "cm|centimeter|centimeters"),
    ("m", "length", 1000.0, 0.0, "m|meter|meters|metre|metres"),
    ("in", "length", 25.4, 0.0, 'in|inch|inches|"'),
    ("ft", "length", 304.8, 0.0, "ft|foot|feet|'"),
    ("l", "volume", 1.0, 0.0, "l|liter|liters|litre|litres"),
    ("ml", "volume", 0.001, 0.0, "ml|milliliter|milliliters|millilitre|millilitres"),
    ("fl_oz_us", "volume", 0.0295735295625, 0.0, "fl_oz_us|us fl oz|us fl. oz.|us fl_oz|us floz|us fluid ounce|us fluid ounces"),
    ("cup_us", "volume", 0.2365882365, 0.0, "cup_us|us cup|us cups"),
    ("pt_us", "volume", 0.473176473, 0.0, "pt_us|us pt|us pint|us pints"),
    ("qt_us", "volume", 0.946352946, 0.0, "qt_us|us qt|us quart|us quarts"),
    ("gal_us", "volume", 3.785411784, 0.0, "gal_us|us gal|us gallon|us gallons"),
    ("kpa", "pressure", 1.0, 0.0, "kpa|kilopascal|kilopascals"),
    ("pa", "pressure", 0.001, 0.0, "pa|pascal|pascals"),
    ("bar", "pressure", 100.0, 0.0, "bar|bars"),
    ("psi", "pressure", 6.894757293168361, 0.0, "psi|lbf/in2|lb/in2|lbf/in^2|lb/in^2|pounds per square inch"),
    ("n_m", "torque", 1.0, 0.0, "n·m|n-m|n*m|nm|n m|newton meter|newton meters|newton-meter|newton-meters|newton-metre|newton metres"),
    ("lb_ft", "torque", 0.45359237 * 9.80665 * 0.3048, 0.0, "lb·ft|lb-ft|lb*ft|lb ft|ft-lb|ft*lb|ft·lb|ft lb|foot-pound|foot pounds|ft-lbs|ft lbs"),
    ("lb_in", "torque", 0.45359237 * 9.80665 * 0.3048 / 12, 0.0, "lb·in|lb-in|lb*in|lb in|in-lb|in*lb|in·lb|in lb|inch-pound|inch pounds|in-lbs|in lbs"),
    ("l_per_min", "flow", 1.0, 0.0, "l/min|l_per_min|lpm|liter per minute|liters per minute|l / min"),
    ("l_per_h", "flow", 1 / 60, 0.0, "l/h|l_per_h|lph|liter per hour|liters per hour|l / h"),
    ("gal_us_per_min", "flow", 3.785411784, 0.0, "gal_us_per_min|us gal/min|us gal per min|us gallon per minute|us gallons per minute|us gal / min|us gpm"),
    ("gal_us_per_h", "flow", 3.785411784 / 60, 0.0, "gal_us_per_h|us gal/h|us gal per hour|us gallon per hour|us gallons per hour|us gal / h|us gph"),
    ("s", "time", 1.0, 0.0, "s|sec|secs|second|seconds"),
    ("ms", "time", 0.001, 0.0, "ms|millisecond|milliseconds"),
    ("min", "time", 60.0, 0.0, "min|minute|minutes"),
    ("h", "time", 3600.0, 0.0, "h|hour|hours"),
    ("deg_c", "temperature", 1.0, 0.0, "c|°c|degc|deg c|deg_c|celsius|centigrade"),
    ("deg_f", "temperature", 5 / 9, -32 * 5 / 9, "f|°f|degf|deg f|deg_f|fahrenheit"),
    ("k", "temperature", 1.0, -273.15, "k|kelvin"),
    ("mm2", "conductor_size", 1.0, 0.0, "mm²|mm2|mm^2|sq mm|sqmm|square millimeter|square millimeters"),
)
#: One row per name: alias, unit, dimension, factor, offset.
UNITS = tuple((name, unit, dimension, factor, offset) for unit, dimension, factor, offset, names in UNIT_NAMES for name in names.split("|"))
#: Fixed values, as the accepted texts must be the same: a number and what stands for its unit; a gauge.
NUMBER_AND_UNIT = r"^([-+]?(?:(?:\d{1,3}(?:,\d{3})+)|(?:\d+(?:\.\d+)?)|(?:\.\d+)))(?:\s*(.+?))?\s*$"
AWG = r"(?i)^\s*(4/0|3/0|2/0|1/0|0000|000|00|0|\d+)\s*(?:(?:awg|american wire gauge)\b)?\s*$"
GAUGE_NAMES = ("awg", "american wire gauge")
FNV_OFFSET, FNV_PRIME, U32 = 2166136261, 16777619, 0xFFFFFFFF


def unit_table(spark: SparkSession) -> DataFrame:
    """``alias, unit_id, dimension, factor, offset``: the fixed rows as a literal table of the plan."""
    rows = ", ".join(f"({_quoted(a)}, '{u}', '{d}', {f!r}D, {o!r}D)" for a, u, d, f, o in UNITS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS units(alias, unit_id, dimension, factor, offset)")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def parsed_quantity(raw: Column) -> Column:
    """Struct ``number, unit`` of a text such as ``1,200 W``; both null where it is no number."""
    text = F.trim(raw)
    number = F.regexp_extract(text, NUMBER_AND_UNIT, 1)
    unit = F.regexp_replace(F.lower(F.trim(F.regexp_extract(text, NUMBER_AND_UNIT, 2))), r"\s+nominal$", "")
    return F.struct(
        F.when(number != "", F.replace(number, F.lit(","), F.lit("")).try_cast("double")).alias("number"),
        F.when(number != "", F.nullif(unit, F.lit(""))).alias("unit"),
    )


def awg_index(raw: Column) -> Column:
    """Gauge index of ``10 AWG``, ``2/0`` or ``000``: n/0 is 1 - n, a run of zeros likewise."""
    g = F.regexp_extract(raw, AWG, 1)
    return (
        F.when(g == "", F.lit(None).cast("int"))
        .when(g.endswith("/0"), 1 - F.substring(g, 1, 1).try_cast("int"))
        .when(g.rlike("^0+$"), 1 - F.length(g))
        .otherwise(g.try_cast("int"))
    )


def collapsed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def decoded(text: Column) -> Column:
    """A text with its percent escapes resolved; one with a broken escape stays as it is, and so does a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def contains_identity(text: Column, identity: Column) -> Column:
    """Whether a text names an identity: as a whole, with no letter or digit next to it; case, and how its words are
    separated, do not matter.  An empty or unknown identity is never named."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(decoded(c)), r"[-_\s]+", " "))
    wanted = plain(identity)
    # the identity as a literal between \\Q and \\E
    literal = F.concat(F.lit("\\Q"), F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), literal, F.lit(r"(?![\p{L}\p{N}])"))
    return F.coalesce((wanted != "") & F.regexp_like(plain(text), bounded), F.lit(False))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of ASCII text, as a non-negative long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(U32)),
    )


def record_digest(*parts: Column) -> Column:
    """sha256 of the parts joined by a separator that keeps their bounds; a null part has a mark of its own."""
    marked = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *marked), 256)


def canonical_object(entries: Column) -> Column:
    """JSON of a map with its keys in order, so that equal maps give equal text; null values stay."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"})


def significant(x: Column, digits: int = 3) -> Column:
    """``x`` to that many significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


_N = r"(\d+(?:\.\d+)?|\.\d+)"
VOLTAGE_RANGE = rf"(?i)^\s*{_N}\s*(?:-|–|to)\s*{_N}\s*(mV|kV|V)\s*(AC|DC)?\s*$"
TRIPLE = rf"(?i)^\s*{_N}\s*[x×]\s*{_N}\s*[x×]\s*{_N}\s*(mm|cm|m|in)\s*$"
_LENGTH_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}
_VOLTS = {"mv": 0.001, "v": 1.0, "kv": 1000.0}


def _factor(unit: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(F.lower(unit) == name, F.lit(value)).otherwise(out)
    return out


def voltage_range(raw: Column) -> Column:
    """Struct ``low_v, high_v, domain`` of a text such as ``10 - 16 V DC``; null where it is no ascending range."""
    part = lambda k: F.regexp_extract(raw, VOLTAGE_RANGE, k)
    f = _factor(part(3), _VOLTS)
    low, high = part(1).try_cast("double") * f, part(2).try_cast("double") * f
    domain = F.nullif(F.lower(part(4)), F.lit(""))
    return F.when(low <= high, F.struct(low.alias("low_v"), high.alias("high_v"), domain.alias("domain")))


def dimensions_mm(raw: Column) -> Column:
    """Struct ``x, y, z`` in millimetres of ``height x width x depth unit``: the first number is the height z."""
    part = lambda k: F.regexp_extract(raw, TRIPLE, k)
    f = _factor(part(4), _LENGTH_MM)
    a, b, c = (part(k).try_cast("double") * f for k in (1, 2, 3))
    return F.when((a > 0) & (b > 0) & (c > 0), F.struct(b.alias("x"), c.alias("y"), a.alias("z")))


def dual_units_agree(raw: Column) -> Column:
    """Whether both halves of ``10 x 20 x 30 in | 254 x 508 x 762 mm`` describe one body: after conversion each pair of
    numbers lies within the half steps of their printed decimals.  Null where a half does not parse."""
    number = F.lit(_N)

    def body(side: Column) -> Column:
        """Values in millimetres, and half a printed step of each."""
        unit = _factor(F.regexp_extract(side, TRIPLE, 4), _LENGTH_MM)
        texts = F.when(side.rlike(TRIPLE), F.regexp_extract_all(side, number, F.lit(1)))
        return F.transform(
            texts,
            lambda t: F.struct(
                (t.try_cast("double") * unit).alias("v"),
                (unit * 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(t, r"\.(\d*)$", 1)))).alias("h"),
            ),
        )

    sides = F.split(raw, r"\|", -1)
    both = F.zip_with(
        body(F.get(sides, F.lit(0))),
        body(F.get(sides, F.lit(1))),
        lambda a, b: F.abs(a["v"] - b["v"]) <= a["h"] + b["h"] + 1e-9,
    )
    return F.when(F.size(sides) == 2, F.forall(both, lambda x: x))


#: Endpoint names that change something, so that a capture never requests them; as path segments the last
#: two are harmless.
ACTIONS = (
    "cart checkout purchase login logout signin signout register edit delete remove save submit add update empty clear "
    "addtocart backlink index"
).split()
HARMLESS_SEGMENTS = ("backlink", "index")
#: Query parameters that act by being there, and those whose value names the action.
ACTING_PARAMETERS = ("add-to-cart", "remove-item", "buy", "purchase", "checkout", "message")
ACTION_PARAMETERS = ("do", "action", "task", "wc-ajax")
#: Forms of cart actions in paths and in values, and names of actions behind a prefix.
CART_SEGMENT = r"^(add|remove)[-_]to[-_]cart$"
CART_VALUE = r"^(add|remove)[-_](to[-_])?cart$"
PREFIXED_ACTION = r"__(add|remove|delete|save|edit)[a-z_-]*$"


def read_only_url(url: Column) -> Column:
    """Whether requesting a URL changes nothing: no segment of its decoded path (without a script ending) and no query
    parameter names an action.  What is no absolute URL, or has a path that does not decode, is not read-only; null is null."""
    absolute = url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]")
    raw = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    # a plus sign is itself in a path, a blank in a query
    path = F.lower(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
    names = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.(php|aspx?)$", ""))
    acting = [a for a in ACTIONS if a not in HARMLESS_SEGMENTS]
    in_path = F.exists(names, lambda s: s.isin(acting) | s.rlike(CART_SEGMENT))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    text = lambda c: F.lower(F.coalesce(F.try_url_decode(c), c))

    def acts(part: Column) -> Column:
        name = F.replace(text(F.substring_index(part, "=", 1)), F.lit("_"), F.lit("-"))
        value = F.when(F.contains(part, F.lit("=")), text(F.regexp_replace(part, "^[^=]*=", ""))).otherwise(F.lit(""))
        named = value.isin(ACTIONS) | value.rlike(CART_VALUE) | value.rlike(PREFIXED_ACTION)
        return name.isin(*ACTING_PARAMETERS) | (name.isin(*ACTION_PARAMETERS) & named)

    in_query = F.exists(F.split(query, "&"), acts)
    return F.when(url.isNotNull(), absolute & ~F.coalesce(in_path, F.lit(True)) & ~in_query)


#: Strings, numbers and what stands between them, in a JSON text.  No part goes back, so long strings take no stack.
_JSON_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


#: Numbers of at most 15 digits that are spelled with the fewest already: what has so few digits names no other double.
_PORTABLE = r"^(?:0|-?(?:[1-9][0-9]{0,6}(?:\.[0-9]{0,6}[1-9])?|[1-9][0-9]{7,14}|0\.[0-9]{0,4}[1-9]))$"
_WHOLE = r"^(-?[1-9][0-9]{0,14})\.0$"


def _unportable(token: Column) -> Column:
    return token.rlike("^-?[0-9]") & ~token.rlike(_PORTABLE)


def _portable_numbers(tokens: Column) -> Column:
    """The tokens, numbers among them as the fewest digits that name the same double: plain from 1e-6 to below 1e21, else with an
    exponent.  Each step is an array of its own, so that nothing is worked out twice.  What is no number, or is spelled so already, has
    a null ``x``, and so nulls in every step: texts that are no numbers would each cost an exception in every cast."""
    lit = F.lit
    read = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.when(_unportable(t), t.try_cast("double")).alias("x")))
    exact = lambda r: F.when(r["x"].isNotNull(), F.format_string("%.16e", F.abs(r["x"])))
    read = F.transform(read, lambda r: F.struct(r["t"].alias("t"), r["x"].alias("x"), exact(r).alias("e")))
    read = F.transform(
        read,
        lambda r: F.struct(
            r["t"].alias("t"), r["x"].alias("x"), F.substring_index(r["e"], "e", -1).try_cast("int").alias("power"),
            F.replace(F.substring_index(r["e"], "e", 1), lit("."), lit("")).alias("all"),
            # whole numbers have exact digits to round
            F.when((F.abs(r["x"]) < 9e18) & (r["x"] == F.rint(r["x"])), F.rpad(F.abs(r["x"]).cast("long").cast("string"), 17, "0")).alias("whole"),
        ),
    )

    def cut_at(r: Column, n: int) -> list[Column]:
        """The first ``n`` digits as a number, and whether the next one rounds them up."""
        digits = F.coalesce(r["whole"], r["all"])
        return [F.left(digits, lit(n)).try_cast("long").alias(f"low{n}"), (F.substr(digits, lit(n + 1)) >= "5").cast("int").alias(f"up{n}")]

    kept = ("t", "x", "power", "all")
    read = F.transform(read, lambda r: F.struct(*[r[k].alias(k) for k in kept], *cut_at(r, 15), *cut_at(r, 16)))

    def fewest(r: Column) -> Column:
        named = []
        for n in (15, 16):
            for c in (r[f"low{n}"] + r[f"up{n}"], r[f"low{n}"] + 1 - r[f"up{n}"]):
                same = F.concat(c.cast("string"), lit("e"), r["power"] - n + 1).try_cast("double") == F.abs(r["x"])
                named.append(F.when(same, c.cast("string")))
        return F.regexp_replace(F.coalesce(*named, r["all"]), "0+$", "")

    read = F.transform(read, lambda r: F.struct(r["t"].alias("t"), r["x"].alias("x"), r["power"].alias("power"), fewest(r).alias("digits")))

    def spelled(r: Column) -> Column:
        digits, power, n = r["digits"], r["power"], F.length(r["digits"])
        fraction = F.when(n > 1, F.concat(lit("."), F.substr(digits, lit(2)))).otherwise(lit(""))
        plain = (
            F.when(r["x"] == 0, lit("0"))
            .when((power >= 21) | (power < -6), F.concat(F.left(digits, lit(1)), fraction, lit("e"), F.when(power > 0, lit("+")).otherwise(lit("")), power))
            .when(power < 0, F.concat(lit("0."), F.repeat(lit("0"), -power - 1), digits))
            .when(n - 1 <= power, F.concat(digits, F.repeat(lit("0"), power - n + 1)))
            .otherwise(F.concat(F.substr(digits, lit(1), power + 1), lit("."), F.substr(digits, power + 2)))
        )
        return F.when(r["x"].isNull(), r["t"]).otherwise(F.concat(F.when(r["x"] < 0, lit("-")).otherwise(lit("")), plain))

    return F.transform(read, spelled)


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of every object in order of their UTF-16 units, at every depth, without blanks, and with
    one spelling of each number and string; so equal values have equal texts, whatever order and spelling they came in.

    Arrays keep their order.  Null where the text is null, no JSON, deeper than 1,000 levels, has a key twice, or a number
    beyond a double.  Numbers are doubles, as they are to most readers.
    """
    numeric = lambda t: t.rlike("^-?[0-9]")
    tokens = lambda c: F.regexp_extract_all(c, F.lit(_JSON_TOKENS), F.lit(0))
    beyond = F.exists(tokens(text), lambda t: numeric(t) & (F.abs(t.try_cast("double")) == float("inf")))
    # a number of less than 200 digits and an exponent below 100 is never beyond
    beyond = text.rlike(r"[0-9.]{200}|[0-9.][eE]\+?[0-9]{3}") & beyond
    sorted_keys = F.to_json(F.try_parse_json(text))
    whole = F.transform(tokens(sorted_keys), lambda t: F.when(t.rlike("^-?[1-9]"), F.regexp_replace(t, _WHOLE, "$1")).otherwise(t))
    # an array of one, so that the tokens are a variable
    spelled = F.transform(F.array(whole), lambda ts: F.array_join(F.when(F.exists(ts, _unportable), _portable_numbers(ts)).otherwise(ts), ""))
    return F.when(~beyond, spelled[0])
