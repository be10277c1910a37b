"""Client schema: served layers with their own numbering, property sets and code translations.

``SCHEMA`` states the property set of each of the 36 served layers as data: a property and the rule that fills
it from the attributes of a built layer. ``client_layer`` turns it into one typed ``select`` per layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import FEATURE_NUMBERS, NOT_APPLICABLE, UNKNOWN, client_code
from ..functions.geo import FT_M, c, rnd
from ..functions.text import client_idrwy, first_threshold, lookup, pad_client
from .ordered import rank, scan

NODE_BASE = 40_000_000


def ft_to_m(v) -> Column:
    return F.coalesce(rnd(c(v) * FT_M, 2), F.lit(float(UNKNOWN)))


# ---- rules: (kind, attribute or value ...) --------------------------------------------------


def fixed(value):
    return ("fixed", value)


def number(*names):
    """The first attribute that has a value, else the unknown code."""
    return ("number", *names)


def word(*names):
    """The first text that has a value, else null."""
    return ("word", *names)


def coded(attr, name=None):
    return ("coded", attr, name or attr)


ABSENT = ("fixed", None)
RUNWAY, THRESHOLD = ("runway", "idrwy"), ("threshold", "idthr")
SURFACE, GROUND = coded("surftype"), coded("gsurftyp", "surftype")
HEIGHTS = {"height": number("height"), "elev": fixed(UNKNOWN), "material": fixed(UNKNOWN)}
FITTINGS = {"marking": fixed(UNKNOWN), "lighting": fixed(UNKNOWN), "radius": fixed(NOT_APPLICABLE)}
LOADS = {"pcn": ABSENT, "restacn": ABSENT}

# The property set of each client layer, in its order.
SCHEMA: dict[str, dict[str, tuple]] = {
    "aerodromereferencepoint": {"name": word("name"), "iata": word("iata"), "elev": ("metres", "elev")},
    "apronelement": {"status": coded("status"), **LOADS, "gsurftyp": GROUND, "idapron": word("idapron")},
    "arrestinggearlocation": {"idthr": THRESHOLD, "status": fixed(1)},
    "asrnedge": {"edgetype": coded("edgetype"), "idnetwrk": ("first", word("idlin"), RUNWAY, word("idstd")), "node1ref": ("node", "stnode"), "node2ref": ("node", "ennode"), "direc": coded("direc"), "edgederv": fixed(0),
                 "edgelen": number("edgelen"), "curvatur": fixed(0.0), "idapron": ABSENT, "pcn": ABSENT, "wingspan": number("wingspan"), "restacn": ABSENT, "idbase": ABSENT},
    "asrnnode": {"nodetype": coded("nodetype"), "idnetwrk": ("first", word("idstd"), RUNWAY, word("name")), "catstop": fixed(UNKNOWN), "featref": fixed(UNKNOWN), "idthr": ("runway_end", "idrwy"), "termref": ABSENT},
    "blastpad": {"idthr": THRESHOLD},
    "constructionarea": {"pstdate": fixed("0001-00-00"), "pendate": fixed("0001-00-00"), "piocdate": fixed("0001-00-00")},
    "deicingarea": {"status": fixed(1), "restacn": ABSENT, "gsurftyp": GROUND, "idbase": word("idapron"), "ident": word("idapron", "deicegrp")},
    "finalapproachandtakeoffarea": {"idrwy": word("ident"), "surftype": SURFACE},
    "frequencyarea": {"frq": number("frq"), "station": ("filled", "name")},
    "helipadthreshold": {"idthr": word("ident"), "status": fixed(1), "ellipse": fixed(UNKNOWN), "geound": fixed(UNKNOWN)},
    "hotspot": {"idhot": word("idhot", "name")},
    "landandholdshortoperationlocation": {"idthr": THRESHOLD, "idp": ("runway", "idcross")},
    "paintedcenterline": {"idrwy": RUNWAY},
    "parkingstandarea": {"idstd": word("idstd"), **LOADS, "gsurftyp": GROUND, "jetway": ("flag", "jetway", 1, 0, UNKNOWN), "fuel": ABSENT, "towing": fixed(UNKNOWN), "gndpower": fixed(UNKNOWN), "idapron": word("idapron"), "termref": word("idapron")},
    "parkingstandlocation": {"idstd": word("idstd"), "acn": ("dotted", "acft"), "termref": word("idapron")},
    "runwaydisplacedarea": {"idthr": THRESHOLD, "status": fixed(1), **LOADS, "surftype": SURFACE},
    "runwayelement": {"idrwy": RUNWAY, **LOADS, "width": number("width"), "length": number("length"), "surftype": SURFACE},
    "runwayexitline": {"idlin": word("idlin"), "status": fixed(1), "color": fixed(0), "style": fixed(0), "direc": fixed(0)},
    "runwayintersection": {"idrwi": ("runway", "idrwi"), **LOADS, "surftype": SURFACE},
    "runwaymarking": {"idrwy": RUNWAY},
    "runwayshoulder": {"idrwy": RUNWAY, "status": fixed(1), "gsurftyp": GROUND},
    "runwaythreshold": {"idthr": THRESHOLD, "status": coded("status"), "tdze": ("metres", "tdze"), "tdzslope": fixed(0.0), "brngtrue": number("brngtrue"), "brngmag": number("brngmag", "brngtrue"), "rwyslope": fixed(0.0),
                        "tora": number("tora"), "toda": number("toda"), "asda": number("asda"), "lda": number("lda"), "vasis": coded("vasis"), "cat": fixed(UNKNOWN), "ellipse": fixed(UNKNOWN), "geound": fixed(UNKNOWN), "thrtype": ("equal", "thrtype", 2)},
    "serviceroad": {"gsurftyp": GROUND, "featbase": fixed(0), "idbase": ABSENT},
    "standguidanceline": {"idstd": word("idstd"), "color": fixed(0), "style": coded("style"), "direc": fixed(0), "wingspan": fixed(UNKNOWN), "status": fixed(1), "termref": ABSENT},
    "stopway": {"idthr": THRESHOLD, "status": fixed(1), "surftype": SURFACE},
    "taxiwayelement": {"idlin": word("idlin"), "idapron": ABSENT, "gsurftyp": GROUND, "bridge": ("flag", "bridge", 2, 0, 0), **LOADS, "status": coded("status")},
    "taxiwayguidanceline": {"idlin": word("idlin"), "status": fixed(1), "wingspan": number("wingspan"), "maxspeed": fixed(UNKNOWN), "color": fixed(0), "style": coded("style"), "direc": coded("direc")},
    "taxiwayholdingposition": {"idlin": word("idlin"), "catstop": coded("catstop"), "status": fixed(1), "idp": RUNWAY},
    "taxiwayintersectionmarking": {"idlin": word("idlin")},
    "taxiwayshoulder": {"status": fixed(1), "gsurftyp": GROUND},
    "touchdownliftoffarea": {"idrwy": word("ident"), "surftype": SURFACE},
    "verticallinestructure": {"linsttyp": coded("linsttyp"), **FITTINGS, **HEIGHTS},
    "verticalpointstructure": {"pntsttyp": coded("pntsttyp"), **FITTINGS, **HEIGHTS},
    "verticalpolygonalstructure": {"plysttyp": coded("plysttyp"), **HEIGHTS, "ident": word("name")},
    "water": {},
}
# Properties a routing node has only for some client node types.
NODE_ONLY = {"catstop": [1], "featref": [1], "idthr": [3], "termref": [5, 9]}


def _filled(rule: tuple, names: set[str]) -> Column:
    """The column of a rule; attributes the layer does not have count as null."""
    kind, *args = rule
    attr = lambda n, t: F.col(n).cast(t) if n in names else F.lit(None).cast(t)
    first = lambda t: F.coalesce(*[attr(n, t) for n in args])
    by_kind = {
        "fixed": lambda: F.lit(args[0]).cast("string") if args[0] is None else F.lit(args[0]),
        "number": lambda: F.coalesce(first("double"), F.lit(float(UNKNOWN))),
        "word": lambda: first("string"),
        "filled": lambda: F.nullif(attr(args[0], "string"), F.lit("")),
        "dotted": lambda: F.replace(attr(args[0], "string"), F.lit("|"), F.lit(".")),
        "metres": lambda: ft_to_m(attr(args[0], "double")),
        "coded": lambda: client_code(args[0], attr(args[1], "int")),
        "runway": lambda: client_idrwy(attr(args[0], "string")),
        "threshold": lambda: pad_client(attr(args[0], "string")),
        "runway_end": lambda: first_threshold(attr(args[0], "string")),
        "node": lambda: F.coalesce(attr(args[0], "long") + (NODE_BASE + 1), F.lit(UNKNOWN)),
        "equal": lambda: F.coalesce((attr(args[0], "int") == args[1]).cast("int"), F.lit(0)),
        "flag": lambda: F.when(attr(args[0], "boolean"), args[1]).when(~attr(args[0], "boolean"), args[2]).otherwise(args[3]),
        "first": lambda: F.coalesce(*[_filled(r, names) for r in args]),
    }
    return by_kind[kind]()


def client_layer(df: DataFrame, layer: str, order: list[str]) -> DataFrame:
    """(icao, id, feattype, idarpt, the property set of the layer): one built layer as clients read it.

    Ids count the rows of an airport in ``order`` (a unique order); routing nodes are numbered by their node id,
    as edges refer to them. Attributes that a layer lacks are null; a null code becomes the default of its list.
    """
    no, names = FEATURE_NUMBERS[layer], set(df.columns)
    numbered = scan(df, ["icao"], order, _n=rank())
    at = F.col("_n").cast("long") + no * 1_000_000
    if layer == "asrnnode" and "nodeid" in names:
        at = F.coalesce(F.col("nodeid").cast("long") + (NODE_BASE + 1), at)
    props = {n: _filled(rule, names) for n, rule in SCHEMA[layer].items()}
    return numbered.select("icao", at.alias("id"), F.lit(no).alias("feattype"), F.coalesce("icao", F.lit("")).alias("idarpt"), *[v.alias(n) for n, v in props.items()])


def _is_text(rule: tuple) -> bool:
    return isinstance(rule[1], str | None) if rule[0] == "fixed" else rule[0] in ("word", "filled", "dotted", "runway", "threshold", "runway_end", "first")


def client_schema(features: DataFrame, order: list[str]) -> DataFrame:
    """(icao, layer, id, property, text, number): every property of built features of any layer, a row each.

    ``features``: icao, layer, the attributes of all layers side by side and a unique ``order`` within an airport and
    layer. One pass: all layers are numbered by one scan. Null properties stay as rows, other layers drop out.
    """
    names = set(features.columns)
    served = features.withColumn("_no", lookup(FEATURE_NUMBERS, "layer")).filter("_no IS NOT NULL")
    numbered = scan(served, ["icao", "layer"], order, _n=rank())
    at = F.col("_no").cast("long") * 1_000_000 + F.col("_n")
    if "nodeid" in names:
        at = F.when(F.col("layer") == "asrnnode", F.coalesce(F.col("nodeid").cast("long") + (NODE_BASE + 1), at)).otherwise(at)

    def row(layer, name, rule):
        v, text = _filled(rule, names), _is_text(rule)
        one = F.struct(F.lit(name).alias("property"), (v if text else F.lit(None).cast("string")).alias("text"), (F.lit(None).cast("double") if text else v.cast("double")).alias("number"))
        return F.when(_filled(SCHEMA[layer]["nodetype"], names).isin(NODE_ONLY[name]), one) if layer == "asrnnode" and name in NODE_ONLY else one

    props = F.lit(None).cast("array<struct<property:string,text:string,number:double>>")
    for layer, rules in SCHEMA.items():
        if rules:
            props = F.when(F.col("layer") == layer, F.array(*[row(layer, n, rule) for n, rule in rules.items()])).otherwise(props)
    return numbered.select("icao", "layer", at.alias("id"), F.explode(F.array_compact(props)).alias("_p")).select("icao", "layer", "id", "_p.*")


def client_json(client: DataFrame, layer: str) -> DataFrame:
    """(icao, layer, id, value): the properties of each feature as one JSON text, nulls written out."""
    def text(names):
        return F.to_json(F.struct("id", "feattype", "idarpt", *names), {"ignoreNullFields": "false"})

    names = list(SCHEMA[layer])
    value = text([n for n in names if layer != "asrnnode" or n not in NODE_ONLY])
    if layer == "asrnnode":
        for kinds in ([1], [3], [5, 9]):
            own = [n for n in names if NODE_ONLY.get(n, kinds) == kinds]
            value = F.when(F.col("nodetype").isin(kinds), text(own)).otherwise(value)
    return client.select("icao", F.lit(layer).alias("layer"), "id", value.alias("value"))


def client_ids(features: DataFrame, order: list[str]) -> DataFrame:
    """Feature number and client id of the 36 served layers; other layers drop out."""
    no = lookup(FEATURE_NUMBERS, "layer")
    served = features.withColumn("feattype", no).filter("feattype IS NOT NULL")
    return scan(served, ["icao", "layer"], order, _n=rank()).withColumn("client_id", F.col("feattype").cast("bigint") * 1000000 + F.col("_n")).drop("_n")
