"""A hand-written shop: one plan per rule, one sheet per rule."""

from platematch.schemas import REQUEST_SCHEMA, TABLES
from platematch.sources import load_domain
from pyspark.sql import types as T


def frame(spark, table, rows):
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(t)) for c, (_, t) in TABLES[table].items()])
    return spark.createDataFrame([tuple(r.get(c) for c in TABLES[table]) for r in rows], schema)


def build_domain(spark, **rows):
    return load_domain(spark, {t: frame(spark, t, rows.get(t, [])) for t in TABLES})


# plan -> its parts as (plate, grade, mode, attributes)
PARTS = {
    1: [("P10", "A", "S", {"alpha1": "H"}), ("P10", "A ", "S", {"alpha1": "L "})],
    2: [("P10", "A", "R", {}), ("P10", "D", None, {})],
    3: [("P10", "A", "C", {"alpha2": "Q2"})],
    4: [("P10", "A", "S", {}), ("P10", "A", "X", {})],
    5: [("P10", "A", None, {})],
    6: [("P10", "A", "S", {}), ("P10x", "A", "S", {})],
    7: [("PN", "A", "S", {})],
    10: [("P10", "C", "R", {})],
    11: [("P10", "A", "S", {"alpha1": "H", "alpha3": "OFF", "alpha18": "V", "alpha4": ""})],
    17: [("P10", "A", "S", {"alpha7": "M"})],
}
SHEETS = {
    # tracking: (code, size, attributes, positions as (plate, quantity))
    100: ("X100", (2000.0, 1000.0), {"alpha1": "H"}, [("P10", 1)]),
    101: ("X101", (2000.0, 1000.0), {"alpha1": "L"}, [("P10", 1)]),
    102: ("X102", (2000.0, 1000.0), {}, [("P10", 1)]),
    103: ("X103", (2000.0, 1000.0), {"alpha2": "Q1"}, [("P10", 1)]),
    104: ("W104", (10.0, 10.0), {"alpha1": "H"}, [("P10", 1)]),
    105: ("X105", (960.0, 1000.0), {"alpha1": "H"}, [("P10", 1)]),
    106: ("X106", (2000.0, 1000.0), {"alpha1": "H"}, [("P10", 0), ("P20", 5)]),
    107: ("X107", (2000.0, 1000.0), {"alpha1": "H"}, [("P10", 1), ("P10B", 2), ("P10", 1)]),
    108: ("X108", (2000.0, 1000.0), {"alpha7": "M"}, [("P10", 1)]),
    109: ("X109", None, None, [("P10", 1)]),
}


def build_shop(spark):
    t = {name: [] for name in TABLES}
    for plan in [*range(1, 12), 17]:
        t["a_nes"].append({"idnes": plan, "olcod": "T1" if plan < 3 else f"T{plan}  ", "nscod": f"N{plan}", "stnes": 4,
                           "macod": "M1", "nsdsc": f"plan {plan}"})
        if plan != 9:
            t["l_pcpa"].append({"idptc": plan, "conum": plan, "locod": 1, "idfas": 1})
            t["a_lav"].append({"idlav": plan * 10, "conum": plan, "locod": 1, "idfas": 1})
        for n, (plate, grade, mode, attrs) in enumerate(PARTS.get(plan, [])):
            t["a_lot"].append({"conum": plan, "locod": 1, "loclm": 100 + n})
            t["l_cmpa"].append({"idrow": plan * 10 + n, "conum": plan, "locod": 100 + n, "pacod": plate,
                                "qualitycode": grade, "comparingmode": mode, **attrs})
        if plan not in (2, 7):
            t["l_pcfo"].append({"idfor": 1, "idptc": plan, "pfdx1": 1000.0, "pfdy1": None if plan == 11 else 500.0})
            t["l_nelm"] += [{"idnes": plan, "idfor": 1, "pcmnx": 0.0, "pcmny": None, "nmrip": 2},
                            {"idnes": plan, "idfor": 1, "pcmnx": 700.0, "pcmny": None, "nmrip": 3}]
    t["l_odla"] = [{"olcod": "LAUNCHED", "idlav": 10}, {"olcod": "LAUNCHED", "idlav": 10}]
    t["a_par"] = [{"pacod": "P10", "padz1": 10.0, "x_jdequality": "A"}, {"pacod": "P10B", "padz1": 10.0, "x_jdequality": "B"},
                  {"pacod": "P10x", "padz1": 10.0004, "x_jdequality": "A"}, {"pacod": "PN", "x_jdequality": "A"},
                  {"pacod": "P20", "padz1": 20.0, "x_jdequality": "A"}]
    t["jdequality"] = [{"code": "A", "description": "a", "grouping": "G1"}, {"code": "B", "description": "b", "grouping": "G1"},
                       {"code": "C", "description": "c"}, {"code": "D", "description": "d", "grouping": "G2"}]
    t["jdecompatibility"] = [{"code": "A", "compatible": "D"}, {"code": "A", "compatible": "Z"}]
    heads = [(1, "Alpha1", "P", 1), (2, "Alpha2", "P", 2), (3, "Alpha3", "P", 0), (7, "Alpha7", "Y", 1), (18, "Alpha18", "V", 1)]
    t["x_jde_attributianagrafica"] = [
        {"id": i, "codicefactory": c, "codicejde": f"J{i}", "descrizione": f"d{i}", "tipocontrollo": k, "controlloabilitato": e}
        for i, c, k, e in heads]
    from decimal import Decimal
    t["x_jde_attributivalori"] = [
        {"id_x_jde_attributianagrafica": i, "codice": c, "peso": Decimal(w)}
        for i, c, w in [(1, "H", 20), (1, "L", 10), (2, "Q1", 1), (2, "Q2", 2), (3, "OFF", 1), (7, "M", 1), (18, "V", 1)]]
    for idcrn, (code, size, attrs, positions) in SHEETS.items():
        t["s_crn"].append({"idcrn": idcrn, "crcod": code + " ", "iddmp": None if size is None else idcrn})
        if size:
            t["s_dmp"].append({"iddmp": idcrn, "numeric1": size[0], "numeric2": size[1], **attrs})
        for k, (plate, qty) in enumerate(positions):
            t["l_mlpr"].append({"idmlpr": idcrn * 10 + k, "idcrn": idcrn, "pacod": plate, "mgcod": "G", "lccod": "L",
                                "crqtr": Decimal(qty)})
    t["x_ghost"] = [{"id": 1, "cutperformed": 0}, {"id": 2, "cutperformed": 1}]
    t["x_ghost_details"] = [{"ghostid": 1, "trackingid": 1000}, {"ghostid": 2, "trackingid": 1030}]
    return build_domain(spark, **t)


def requests(spark):
    rows = [(p, None, p, None, None, False, None) for p in range(1, 12)]
    rows += [
        (12, None, 11, None, None, False, [10, None, 10]),       # job list drives the parts, the plan the shape
        (13, "T1", None, None, None, False, [None]),             # a list of nulls is still a list
        (14, " T1\t", None, None, None, False, []),              # newest plan of the ticket
        (15, "T1", None, "nope", None, False, None),             # code unknown, ticket known
        (16, "LAUNCHED", None, None, None, False, None),         # only launched jobs
        (17, None, 17, None, None, False, None),                 # a control type nobody knows
        (18, None, 1, None, None, True, None),                   # only stock that is there
        (19, None, None, "N1 ", None, None, None),
        (20, None, 1, None, "X100", False, None),
        (21, None, 1, None, "X101", False, None),
        (22, None, 1, None, "X102", False, None),
        (23, None, 6, None, "X105", False, None),                # in error, still verified
        (24, None, 1, None, "X106", True, None),
        (25, None, 3, None, "X103", False, None),
        (26, None, 7, None, "W104", False, None),
        (27, None, 1, None, "X107", False, None),
        (28, " ", None, "", None, False, None),                  # names nothing
        (29, None, 1, None, "X109", False, None),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], REQUEST_SCHEMA)
