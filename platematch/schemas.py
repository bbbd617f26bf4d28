"""Columns the operators read, per source table.

Kinds: ``code`` columns are right-trimmed at ingest, the rest is taken as it is.
The type is used only for columns the source lacks, which arrive as typed nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ALPHA_COUNT = 18
ALPHAS = tuple(f"alpha{i}" for i in range(1, ALPHA_COUNT + 1))
# Catalogue spelling of the attribute columns.
ALPHA_NAMES = tuple(f"Alpha{i}" for i in range(1, ALPHA_COUNT + 1))

_CODE, _TEXT, _LONG, _INT = ("code", "string"), ("value", "string"), ("value", "bigint"), ("value", "int")
_DOUBLE, _WEIGHT, _TIME = ("value", "double"), ("value", "decimal(18,6)"), ("value", "timestamp_ntz")
_ALPHA_BLOCK = {a: _CODE for a in ALPHAS}

TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "a_nes": {"idnes": _LONG, "olcod": _CODE, "nscod": _CODE, "nsdsc": _TEXT, "macod": _CODE, "stnes": _INT,
              "dtexp": _TIME, "nsnot": _TEXT, "x_op_ass": _CODE, "tempo": _TEXT},
    "a_mac": {"macod": _CODE, "madsc": _TEXT},
    "a_lav": {"idlav": _LONG, "conum": _LONG, "locod": _INT, "idfas": _INT},
    "l_pcpa": {"idptc": _LONG, "conum": _LONG, "locod": _INT, "idfas": _INT},
    "l_odla": {"olcod": _CODE, "idlav": _LONG},
    "a_lot": {"conum": _LONG, "locod": _INT, "loclm": _INT},
    "l_cmpa": {"idrow": _LONG, "conum": _LONG, "locod": _INT, "pacod": _CODE, "qualitycode": _CODE,
               "comparingmode": _CODE, **_ALPHA_BLOCK},
    "a_par": {"pacod": _CODE, "padsc": _TEXT, "padz1": _DOUBLE, "x_jdequality": _CODE},
    "jdequality": {"code": _CODE, "description": _TEXT, "grouping": _CODE},
    "jdecompatibility": {"code": _CODE, "compatible": _CODE},
    "x_jde_attributianagrafica": {"id": _INT, "codicefactory": _CODE, "codicejde": _TEXT, "descrizione": _TEXT,
                                  "tipocontrollo": _CODE, "controlloabilitato": _INT},
    "x_jde_attributivalori": {"id_x_jde_attributianagrafica": _INT, "codice": _CODE, "peso": _WEIGHT},
    "l_nelm": {"idnes": _LONG, "idfor": _INT, "pcmnx": _DOUBLE, "pcmny": _DOUBLE, "nmrip": _INT},
    "l_pcfo": {"idfor": _INT, "idptc": _LONG, "pfdx1": _DOUBLE, "pfdy1": _DOUBLE, "pfdz1": _DOUBLE, "mtcod": _CODE},
    "a_tmt": {"tmcod": _CODE, "tmdsc": _TEXT},
    "a_com": {"conum": _LONG, "ctdsc": _TEXT},
    "s_crn": {"idcrn": _LONG, "crcod": _CODE, "iddmp": _LONG},
    "s_dmp": {"iddmp": _LONG, "numeric1": _DOUBLE, "numeric2": _DOUBLE, **_ALPHA_BLOCK},
    "l_mlpr": {"idmlpr": _LONG, "idcrn": _LONG, "pacod": _CODE, "mgcod": _CODE, "lccod": _CODE, "crqtr": _WEIGHT},
    "x_ghost": {"id": _LONG, "cutperformed": _INT},
    "x_ghost_details": {"ghostid": _LONG, "trackingid": _LONG},
    "workplanjobssheets": {"workplanid": _LONG, "storelocationparttrackingid": _LONG},
    "xt_lista_di_prelievo": {"id": _LONG, "datacreazione": _TIME, "operatore": _TEXT, "stato": _TEXT},
    "xt_lista_di_prelievo_righe": {"idlista": _LONG, "idnesting": _LONG},
}

# Tables the source may lack altogether; they read as empty.
OPTIONAL_TABLES = {"workplanjobssheets", "x_ghost", "x_ghost_details"}

# Marks a column that the source lacks and that was filled with nulls.
ABSENT = {"absent": True}


def has_column(df: DataFrame, name: str) -> bool:
    """Whether the table has the column from its source; one filled in by the reader does not count."""
    return any(f.name.lower() == name and not f.metadata.get("absent") for f in df.schema.fields)


REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("job_ticket_code", T.StringType()),
    T.StructField("nesting_id", T.LongType()),
    T.StructField("nesting_code", T.StringType()),
    T.StructField("tracking_code", T.StringType()),
    T.StructField("only_available", T.BooleanType()),
    T.StructField("jobs", T.ArrayType(T.LongType())),
    # Asks to verify the named tracking; without it a request with a tracking code verifies, one without lists.
    T.StructField("verify", T.BooleanType()),
])
