"""Designators, names, lengths, signs and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import FT_M, c, clamp


def ident_num(s) -> Column:
    """Leading number of a designator, null without one."""
    return F.expr("try_cast(null as int)") if s is None else F.regexp_extract(c(s), r"^(\d+)", 1).try_cast("int")


def pair_id(a, b) -> Column:
    """``09/27`` style pair, lower number first; kept as given if either has no number."""
    a, b = c(a), c(b)
    return F.when(F.coalesce(ident_num(b) < ident_num(a), F.lit(False)), F.concat(b, F.lit("/"), a)).otherwise(
        F.concat(a, F.lit("/"), b))


def pad_source(s) -> Column:
    """Zero-pad a one-digit scenery designator such as ``9R``; leave anything else alone."""
    t = F.trim(c(s))
    return F.when(t.rlike(r"^\d[LRCWTSG]?$"), F.concat(F.lit("0"), t)).otherwise(t)


def pad_registry(s) -> Column:
    """Upper-case registry designator with a two-digit number."""
    t = F.upper(F.trim(c(s)))
    num = ident_num(t)
    padded = F.when(num < 10, F.concat(F.lit("0"), num.cast("string"))).otherwise(num.cast("string"))
    return F.when(num.isNull(), t).otherwise(F.concat(padded, F.regexp_replace(t, r"^\d+", "")))


def pad_client(s) -> Column:
    """Zero-pad a designator that starts with exactly one digit."""
    s = c(s)
    return F.when(s.rlike(r"^\d(\D|$)"), F.concat(F.lit("0"), s)).otherwise(s)


def client_idrwy(s) -> Column:
    """``07L/25R+18/36`` -> ``07L.25R_18.36``."""
    return F.array_join(F.transform(F.split(c(s), r"\+"), lambda pair: F.array_join(
        F.transform(F.split(pair, "/"), pad_client), ".")), "_")


def first_threshold(s) -> Column:
    parts = F.filter(F.transform(F.split(c(s), r"[/._+ ]"), F.trim), lambda v: v != "")
    return F.coalesce(pad_client(F.get(parts, F.lit(0))), F.lit(""))


def length_m(v) -> Column:
    """Length text in metres: bare or ``m`` as given, ``ft`` or ``'`` converted."""
    t = F.lower(F.trim(c(v)))
    num = r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)\s*"
    metres = F.regexp_extract(t, num + "m?$", 1).try_cast("double")
    feet = F.regexp_extract(t, num + r"(?:ft|')$", 1).try_cast("double")
    return F.coalesce(metres, feet * FT_M)


def height_m(tags) -> Column:
    """``height`` tag, else levels at 3.5 m each."""
    t = c(tags)
    return F.coalesce(length_m(t["height"]), t["building:levels"].try_cast("double") * 3.5)


def tag_name(tags) -> Column:
    t = c(tags)
    return F.coalesce(F.nullif(t["ref"], F.lit("")), F.nullif(t["name"], F.lit("")))


# Keyword lists deciding what a pavement description means, in test order.
PAVEMENT_HINTS = [
    ("apron", ["apron", "ramp", "gate", "terminal", "cargo", "parking", "stand", "tie", "hangar"]),
    ("road", ["road", "street"]),
    ("runway", ["runway", "rwy"]),
    ("helipad", ["heli"]),
    ("taxiway", ["taxi", "twy"]),
]
# Regular expressions deciding the class of an apron name, in test order.
APRON_KINDS = [
    (2, "cargo|freight"),
    (3, "ga |^ga|general|tie"),
    (4, "maint|mro|hangar"),
    (5, "mil"),
    (6, "deic|de-ic"),
    (7, "fuel"),
    (8, "heli"),
    (1, "gate|terminal|apron|ramp|stand"),
]


def pavement_hint(name) -> Column:
    n = F.lower(c(name))
    out = F.when(n.isNull(), "unknown")
    for hint, words in PAVEMENT_HINTS:
        test = n.rlike("|".join(words))
        out = out.when(test | (F.length(n) <= 3) if hint == "taxiway" else test, hint)
    return out.otherwise("unknown")


def apron_kind(name) -> Column:
    n = F.lower(c(name))
    out = F.when(n.isNull(), 0)
    for code, pattern in APRON_KINDS:
        out = out.when(n.rlike(pattern), code)
    return out.otherwise(0)


# Continent codes by the words people type for them.
CONTINENTS = {
    "af": "AF", "africa": "AF", "an": "AN", "antarctica": "AN", "as": "AS", "asia": "AS",
    "eu": "EU", "europe": "EU", "na": "NA", "northamerica": "NA", "north": "NA",
    "oc": "OC", "oceania": "OC", "australia": "OC", "pacific": "OC",
    "sa": "SA", "southamerica": "SA", "south": "SA",
}


def lookup(table: dict, key, default=None) -> Column:
    """Value of a small fixed code table for a key column."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, c(key)), F.lit(default)) if default is not None else F.try_element_at(m, c(key))


def continent_code(s) -> Column:
    return lookup(CONTINENTS, F.regexp_replace(F.lower(F.trim(c(s))), "[^a-z0-9]", ""))


def us_coverage(icao, country) -> Column:
    """True where the US publishes mapping data: country text first, code prefix otherwise."""
    k = F.upper(F.trim(c(country)))
    u = F.upper(c(icao))
    named = k.isin("US", "USA") | k.startswith("US ") | k.startswith("USA ") | k.contains("UNITED STATES")
    return (F.when(F.coalesce(named, F.lit(False)), True)
            .when(F.coalesce(F.length(k).isin(2, 3), F.lit(False)), False)
            .otherwise(u.rlike("^(K|PA|PH)")))


def cycle_start(day, epoch: str) -> Column:
    """Start of the 28-day cycle holding ``day``, counted from a known start."""
    e = F.to_date(F.lit(epoch))
    n = F.floor(F.datediff(c(day), e) / 28).cast("int")
    return F.date_add(e, n * 28)


# Known cycle starts of the US registry and of the navigation data calendar.
REGISTRY_EPOCH = "2024-01-25"
CALENDAR_EPOCH = "2026-09-03"


def cycle_number(start) -> Column:
    """``YYnn`` of a cycle start: nn counts the starts falling in its year."""
    s = c(start)
    nn = F.floor((F.dayofyear(s) - 1) / 28).cast("int") + 1
    return (F.year(s) % 100) * 100 + nn


def cycle_file(start) -> Column:
    return F.concat(F.date_format(c(start), "dd_MMM_yyyy"), F.lit("_CSV.zip"))


def decode_entities(s) -> Column:
    """XML entities decoded once; the ampersand goes last."""
    out = c(s)
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def tidy_name(s, limit: int = 20) -> Column:
    """Structure label: cut at a gate, bracket or comma, then shorten."""
    t = F.trim(c(s))
    for cut in (" Gate ", r" \(", ", "):
        t = F.rtrim(F.regexp_replace(t, f"(?s){cut}.*$", ""))
    return F.rtrim(F.substring(t, 1, limit))


def tidy_stand(s, limit: int = 12) -> Column:
    """Stand label: drop a trailing bracket, keep what follows the last ``Gate``."""
    t = F.trim(c(s))
    t = F.rtrim(F.regexp_replace(t, r"(?s)^(.*) \(.*$", "$1"))
    tail = F.trim(F.regexp_extract(t, r"(?s)^.* Gate (.*)$", 1))
    return F.rtrim(F.substring(F.when(tail != "", tail).otherwise(t), 1, limit))


def degree_minutes(v, pos: str, neg: str, width: int) -> Column:
    a = F.abs(c(v))
    d = F.floor(a)
    return F.concat(F.when(c(v) >= 0, pos).otherwise(neg), F.format_string(f"%0{width}d° %04.1f'", d.cast("bigint"), (a - d) * 60))


def coord_text(lat, lon) -> Column:
    return F.concat(degree_minutes(lat, "N", "S", 2), F.lit("  "), degree_minutes(lon, "E", "W", 3))


# Sign glyph tokens and what they print.
GLYPHS = {
    "^u": "↑", "^d": "↓", "^l": "←", "^r": "→",
    "^lu": "↖", "^ul": "↖", "^ru": "↗", "^ur": "↗",
    "^ld": "↙", "^dl": "↙", "^rd": "↘", "^dr": "↘",
    "r1": "I", "r2": "II", "r3": "III",
    "hazard": "[HAZARD]", "safety": "[SAFETY]", "critical": "[CRITICAL]",
    "no-entry": "⛔", "_": " ", "*": "·", "|": "|", "comma": ",",
}
# Sign type by style letter, and sign height by size.
SIGN_STYLES = {"R": 1, "Y": 2, "L": 3, "B": 4}
SIGN_HEIGHTS = {1: 0.6, 2: 0.8, 3: 1.2, 4: 1.2}


def decode_sign(raw) -> dict[str, Column]:
    """Front text, back text and type of a raw sign string, without leaving the row.

    The string is tokenised into brace groups and single characters; brace groups split on
    commas. ``@@`` turns to the back, ``@X`` sets a style, anything else prints.
    """
    # A group without its closing brace runs to the end of the text.
    groups = F.regexp_extract_all(c(raw), F.lit(r"(?s)(\{[^}]*(?:\}|$)|[^{])"), F.lit(1))
    tokens = F.flatten(F.transform(groups, lambda g: F.when(
        g.startswith("{"),
        F.filter(F.transform(F.split(F.regexp_replace(g, r"^\{|\}$", ""), ","),
                             lambda t: F.struct(F.trim(t).alias("t"), F.lit(True).alias("code"))), lambda t: t.t != ""),
    ).otherwise(F.array(F.struct(g.alias("t"), F.lit(False).alias("code"))))))

    def is_back(t):
        return t.code & (t.t == "@@")

    def is_style(t):
        return t.code & t.t.startswith("@") & (t.t != "@@")

    start = F.struct(F.lit("").alias("front"), F.lit("").alias("back"), F.lit(False).alias("turned"),
                     F.lit(None).cast("string").alias("style"))

    def step(acc, t):
        printed = F.when(is_back(t) | is_style(t), "").when(t.code, lookup_str(GLYPHS, t.t)).otherwise(t.t)
        letter = F.upper(F.substring(t.t, 2, 1))
        letter = F.when(letter == "", "Y").otherwise(letter)
        return F.struct(
            F.when(acc.turned, acc.front).otherwise(F.concat(acc.front, printed)).alias("front"),
            F.when(acc.turned, F.concat(acc.back, printed)).otherwise(acc.back).alias("back"),
            (acc.turned | is_back(t)).alias("turned"),
            F.coalesce(acc.style, F.when(is_style(t), letter)).alias("style"))

    done = F.aggregate(tokens, start, step)
    return {
        "msgfront": done.front,
        "msgback": F.nullif(done.back, F.lit("")),
        "signtype": F.coalesce(lookup(SIGN_STYLES, done.style), F.lit(0)),
    }


def lookup_str(table: dict, key) -> Column:
    """Translated token, or the token itself."""
    return F.coalesce(lookup(table, key), c(key))


def road_width(tags) -> Column:
    """Width tag, else lanes at 3.25 m, else by road class."""
    t = c(tags)
    lanes = t["lanes"].try_cast("double")
    cls = t["highway"]
    by_class = (F.when(cls.isin("service", "track"), 5.0).when(cls.isin("residential", "unclassified"), 6.5)
                .when(cls.isin("tertiary", "secondary"), 8.0).when(cls.isin("primary", "trunk", "motorway"), 12.0)
                .otherwise(5.0))
    return F.coalesce(clamp(length_m(t["width"]), 2.0, 30.0),
                      F.when(lanes > 0, clamp(lanes * 3.25, 3.0, 30.0)), by_class)
