"""Client property sets: ids, null rules and JSON of the served layers."""

import json

from aerodeck.functions.codes import FEATURE_NUMBERS
from aerodeck.operators import client

ATTRIBUTES = "icao string, fid long, idrwy string, idthr string, status int, tdze double, brngtrue double, tora double, vasis int, thrtype int, nodetype int, nodeid long, idstd string, surftype int, bridge boolean, idlin string"


def _rows(spark):
    return spark.createDataFrame([
        ("XA", 7, "7L/25R+18/36", "7L", 2, 100.0, 71.5, None, 1, 2, 2, 5, None, 12, True, "A"),
        ("XA", 3, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("XB", 9, "9/27", "27", 1, None, 90.0, 1500.0, 9, 1, 5, 0, "G1", 4, False, None),
    ], ATTRIBUTES)


def test_threshold_values_and_defaults(spark):
    out = {(r.icao, r.id): r for r in client.client_layer(_rows(spark), "runwaythreshold", ["fid"]).collect()}
    assert set(out) == {("XA", 2000001), ("XA", 2000002), ("XB", 2000001)}
    full, empty = out["XA", 2000002], out["XA", 2000001]
    assert (full.idthr, full.status, full.tdze, full.brngtrue, full.brngmag, full.tora, full.vasis, full.thrtype) == ("07L", 0, 30.48, 71.5, 71.5, -32767.0, 1, 1)
    assert (empty.idthr, empty.status, empty.tdze, empty.brngmag, empty.vasis, empty.thrtype) == (None, 1, -32767.0, -32767.0, 0, 0)


def test_nodes_keep_their_number_and_own_properties(spark):
    nodes = client.client_layer(_rows(spark), "asrnnode", ["fid"])
    value = {r.id: json.loads(r.value) for r in client.client_json(nodes, "asrnnode").collect()}
    assert set(value) == {40000006, 40000001}  # a node without a number counts on like any other layer
    assert client.client_json(nodes, "asrnnode").count() == 3
    assert value[40000006] == {"id": 40000006, "feattype": 40, "idarpt": "XA", "nodetype": 3, "idnetwrk": "07L.25R_18.36", "idthr": "07L"}


def test_attributes_that_a_layer_lacks_are_null(spark):
    one = client.client_layer(_rows(spark).select("icao", "fid"), "taxiwayelement", ["fid"]).filter("icao = 'XB'").first()
    assert (one.idlin, one.gsurftyp, one.bridge, one.status, one.pcn) == (None, -32767, 0, 1, None)


def test_every_served_layer_in_one_pass_equals_each_layer_alone(spark):
    layers = spark.createDataFrame([(n,) for n in [*FEATURE_NUMBERS, "bridgeside"]], "layer string")
    wide = _rows(spark).crossJoin(layers)
    got = {(r.icao, r.layer, r.id, r.property, r.text, r.number) for r in client.client_schema(wide, ["fid"]).collect()}
    want = set()
    for n, rules in client.SCHEMA.items():
        for r in client.client_layer(_rows(spark), n, ["fid"]).collect():
            for p in rules:
                if n == "asrnnode" and r.nodetype not in client.NODE_ONLY.get(p, [r.nodetype]):
                    continue
                v = r[p]
                want.add((r.icao, n, r.id, p, v if isinstance(v, str) else None, None if v is None or isinstance(v, str) else float(v)))
    assert got == want
