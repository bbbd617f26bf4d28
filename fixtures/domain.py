"""Plate-cutting domain tables expressed as SQL over the driver's tables.

Every statement runs unchanged on Spark and on DuckDB, so the same text feeds
the Spark temp views and the ``WITH`` prefix of the oracle queries.  Nothing is
sampled: each driver row takes part, and the request set holds one request per
order.  Rules kept for portability: ``||`` instead of ``concat``, explicit casts
of ``floor`` results, ``VALUES`` instead of ``range``, DOUBLE literals cast.

Codes carry trailing blanks on purpose in some columns (``macod``, ``alpha1``,
``qualitycode``); ingest right-trims them once and the oracle does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platematch.session import stage

DRIVER_TABLES = ("region", "customer", "supplier", "part", "orders", "lineitem", "events")
# Two shuffles of the order lines behind eight of the tables.
SHARED = ("order_line",)


def _half(col: str, by: int) -> str:
    return f"CAST(CAST(floor({col}/{by}) AS BIGINT) AS STRING)"


# name -> SQL.  Order matters: later entries may read earlier ones.
DOMAIN_SQL: dict[str, str] = {}

DOMAIN_SQL["a_nes"] = f"""
SELECT o_orderkey AS idnes,
  lpad({_half('o_orderkey', 2)}, 10, '0') AS olcod,
  'N-' || {_half('o_orderkey', 3)} AS nscod,
  'PLAN ' || o_orderpriority AS nsdsc,
  CASE o_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'DLG-ALL_PLASMA' WHEN 2 THEN '  '
       ELSE 'M' || CAST(o_custkey % 7 AS STRING) || ' ' END AS macod,
  CASE o_orderstatus WHEN 'O' THEN 4 WHEN 'P' THEN 3 ELSE 5 END AS stnes,
  CASE WHEN o_totalprice < 60000 THEN NULL ELSE o_orderdate END AS dtexp,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN ''
       ELSE 'note "' || o_orderstatus || '"' END AS nsnot,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'OP' || CAST(o_custkey % 20 AS STRING) END AS x_op_ass,
  CASE o_orderkey % 7 WHEN 0 THEN '1.5' WHEN 1 THEN '1,5' WHEN 2 THEN '1.234,5' WHEN 3 THEN '2:30'
       WHEN 4 THEN '1:30:36' WHEN 5 THEN '1.02:15' ELSE NULL END AS tempo
FROM orders"""

DOMAIN_SQL["a_mac"] = """
SELECT 'M' || CAST(r_regionkey AS STRING) AS macod, ' ' || r_name || ' ' AS madsc FROM region"""

# One row per (order, line); every line but the large seventh one is cut from the order's lead plate.
DOMAIN_SQL["order_line"] = """
SELECT conum, locod, qty, lead_part, least_qty,
  CASE WHEN locod = 7 AND qty > 25 THEN own_part ELSE lead_part END AS pacod
FROM (
  SELECT conum, locod, own_part, qty,
    min(own_part) OVER (PARTITION BY conum) AS lead_part,
    min(qty) OVER (PARTITION BY conum) AS least_qty
  FROM (SELECT l_orderkey AS conum, l_linenumber AS locod, min(l_partkey) AS own_part,
               CAST(min(l_quantity) AS INT) AS qty
        FROM lineitem GROUP BY l_orderkey, l_linenumber) AS g) AS w"""

DOMAIN_SQL["a_lav"] = """
SELECT conum * 100 + locod AS idlav, conum, locod, 1 AS idfas FROM order_line"""

DOMAIN_SQL["l_pcpa"] = """
SELECT conum AS idptc, conum, locod, 1 AS idfas FROM order_line"""

DOMAIN_SQL["l_odla"] = f"""
SELECT 'L' || lpad({_half('conum', 4)}, 9, '0') AS olcod,
  CASE WHEN qty <= 30 THEN conum * 100 + locod ELSE -(conum * 100 + locod) END AS idlav
FROM order_line"""

DOMAIN_SQL["a_lot"] = """
SELECT conum, locod, CASE WHEN least_qty <= 45 THEN locod + 100 ELSE locod + 900 END AS loclm FROM order_line"""

DOMAIN_SQL["a_par"] = """
SELECT p_partkey AS pacod, p_name AS padsc,
  CASE WHEN p_size <= 10 THEN CAST(15 AS DOUBLE) WHEN p_size = 50 THEN NULL
       ELSE CAST(8 + p_size AS DOUBLE) / CAST(2 AS DOUBLE) END AS padz1,
  'Q' || lpad(CAST(p_partkey % 12 AS STRING), 2, '0') AS x_jdequality
FROM part"""

# Attribute columns without a catalogue entry: they are unpivoted and never required.
_FILLER_COLUMNS = (2, 4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17)
_FILLER = "\n  ".join(f"CASE WHEN o.qty % {n + 9} = {n} THEN 'Z{n}' WHEN o.qty % {n + 9} = 0 THEN ' ' ELSE NULL END AS alpha{n},"
                      for n in _FILLER_COLUMNS)

DOMAIN_SQL["l_cmpa"] = f"""
SELECT o.conum * 100 + o.locod AS idrow, o.conum AS conum, o.locod + 100 AS locod, o.pacod AS pacod,
  p.x_jdequality || ' ' AS qualitycode,
  CASE WHEN o.qty = 50 THEN 'Z' WHEN o.qty % 10 = 0 THEN NULL WHEN o.qty % 10 < 3 THEN 'S'
       WHEN o.qty % 10 < 8 THEN 'C' ELSE 'R' END AS comparingmode,
  CASE WHEN o.qty % 3 = 0 THEN NULL ELSE 'A' || CAST(o.qty % 3 AS STRING) || ' ' END AS alpha1,
  CASE WHEN o.qty % 4 = 0 THEN '' ELSE 'B' || CAST(o.qty % 4 AS STRING) END AS alpha3,
  CASE WHEN o.qty % 6 = 0 THEN 'C1' ELSE NULL END AS alpha5,
  CASE WHEN o.qty = 13 THEN 'F1' ELSE NULL END AS alpha7,
  CASE WHEN o.qty % 5 = 0 THEN 'E1' ELSE NULL END AS alpha9,
  {_FILLER}
  CASE WHEN o.qty % 7 = 0 THEN 'D1' ELSE NULL END AS alpha18
FROM order_line o JOIN a_par p ON p.pacod = o.pacod"""

DOMAIN_SQL["jdequality"] = """
SELECT * FROM (VALUES ('Q00','S235JR','G0'), ('Q01','S235J0','G0'), ('Q02','S235J2','G0'),
  ('Q03','S275JR','G1'), ('Q04','S275J0','G1'), ('Q05','S275J2','G1'),
  ('Q06','S355JR','G2'), ('Q07','S355J0','G2'), ('Q08','S355J2','G2'), ('Q09','S355K2','G2'),
  ('Q10','S460N',NULL), ('Q11','S690Q','G3')) AS t(code, description, grouping)"""

DOMAIN_SQL["jdecompatibility"] = """
SELECT * FROM (VALUES ('Q00','Q01'), ('Q00','Q02'), ('Q00','Q03'), ('Q01','Q02'), ('Q02','Q05'),
  ('Q03','Q04'), ('Q04','Q05'), ('Q05','Q08'), ('Q06','Q07'), ('Q06','Q08'), ('Q07','Q08'),
  ('Q08','Q09'), ('Q08','QXX'), ('Q10','Q11'), ('Q11','Q11')) AS t(code, compatible)"""

DOMAIN_SQL["x_jde_attributianagrafica"] = """
SELECT * FROM (VALUES (1,'Alpha1','T01','PAINT','P',1), (3,'Alpha3','T03','QUALITY GRADE','P',1),
  (5,'Alpha5','T05','TEST','P',2), (7,'Alpha7','T07','MILL','X',1), (9,'Alpha9','T09','DISABLED','P',0),
  (18,'Alpha18','T18','ZINC','V',1)) AS t(id, codicefactory, codicejde, descrizione, tipocontrollo, controlloabilitato)"""

DOMAIN_SQL["x_jde_attributivalori"] = """
SELECT aid AS id_x_jde_attributianagrafica, codice, CAST(w AS DECIMAL(18,6)) AS peso
FROM (VALUES (1,'A0',0), (1,'A1',10), (1,'A2',20), (3,'B0',0), (3,'B1',10), (3,'B2',20), (3,'B3',30),
  (5,'C0',0), (5,'C1',5), (7,'F1',1), (9,'E1',1), (18,'D1',1)) AS t(aid, codice, w)"""

# Rows that stand for a missing link carry a key that nothing else has.
_SHAPE = """SELECT {i} AS idfor, CASE WHEN o_totalprice >= 40000 THEN o_orderkey ELSE -1 - o_orderkey END AS idptc,
  CAST(900 + (o_orderkey * 31 + {i} * 17) % 1500 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS pfdx1,
  CAST(400 + (o_orderkey * 47 + {i} * 29) % 1200 AS DOUBLE) AS pfdy1,
  CAST(15 AS DOUBLE) AS pfdz1,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey % 7 END AS mtcod
FROM orders{where}"""
DOMAIN_SQL["l_pcfo"] = (
    "\n" + _SHAPE.format(i=0, where="")
    + "\nUNION ALL " + _SHAPE.format(i=1, where=" WHERE o_orderstatus = 'P'")
)

DOMAIN_SQL["l_nelm"] = """
SELECT conum AS idnes, CASE WHEN qty > 40 THEN 1 ELSE 0 END AS idfor,
  CASE WHEN locod % 3 = 0 THEN NULL WHEN locod % 3 = 1 THEN CAST(0 AS DOUBLE)
       ELSE CAST(1000 + conum % 500 AS DOUBLE) END AS pcmnx,
  CASE WHEN locod % 3 = 2 THEN CAST(600 + conum % 300 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pcmny,
  qty AS nmrip
FROM order_line"""

DOMAIN_SQL["a_tmt"] = """
SELECT * FROM (VALUES (0,'PLATE A'), (1,'PLATE B'), (2,'STRIP'), (3,'COIL'), (4,'TREAD PLATE')) AS t(tmcod, tmdsc)"""

DOMAIN_SQL["a_com"] = """
SELECT o_orderkey AS conum, c_name AS ctdsc FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey AS conum, 'Group ' || CAST(o_custkey % 7 AS STRING) AS ctdsc
FROM orders WHERE o_orderstatus = 'F'"""

_TRACKING = """SELECT p_partkey * 10 + {i} AS idcrn,
  CASE WHEN (p_partkey + {i}) % 9 = 0 THEN 'W' ELSE 'X' END || CAST(p_partkey * 10 + {i} AS STRING) AS crcod,
  CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE p_partkey * 10 + {i} END AS iddmp
FROM part"""
DOMAIN_SQL["s_crn"] = "\n" + _TRACKING.format(i=0) + "\nUNION ALL " + _TRACKING.format(i=1)

_PLATE_FILLER = "\n  ".join(
    f"CASE WHEN p_partkey % {n + 9} = {n} THEN 'Z{n}' ELSE NULL END AS alpha{n}," for n in (*_FILLER_COLUMNS, 9))
_PLATE = """SELECT p_partkey * 10 + {i} AS iddmp,
  CAST(1000 + (p_partkey * 37 + {i} * 911) % 3000 AS DOUBLE) AS numeric1,
  CAST(500 + (p_partkey * 53 + {i} * 577) % 2500 AS DOUBLE) AS numeric2,
  CASE WHEN (p_partkey + {i}) % 5 = 0 THEN NULL ELSE 'A' || CAST((p_partkey + {i}) % 3 AS STRING) END AS alpha1,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'B' || CAST((p_partkey * 3 + {i}) % 4 AS STRING) END AS alpha3,
  CASE WHEN (p_partkey + {i}) % 3 = 0 THEN 'C0' WHEN (p_partkey + {i}) % 2 = 0 THEN 'C1' ELSE NULL END AS alpha5,
  CASE WHEN p_brand = 'Brand#3' THEN 'F1' ELSE NULL END AS alpha7,
  {filler}
  CASE WHEN p_partkey % 8 = 0 THEN 'D1' ELSE NULL END AS alpha18
FROM part"""
DOMAIN_SQL["s_dmp"] = "\n" + _PLATE.format(i=0, filler=_PLATE_FILLER) + "\nUNION ALL " + _PLATE.format(i=1, filler=_PLATE_FILLER)

# Second position of a tracking holds a neighbouring plate; the third repeats the first position exactly.
_POSITION = """SELECT (p_partkey * 10 + {i}) * 10 + {k} AS idmlpr, p_partkey * 10 + {i} AS idcrn, {plate} AS pacod,
  'G0' || CAST(p_partkey % 3 AS STRING) AS mgcod, 'LOC{loc}' AS lccod,
  CAST((p_partkey * 7 + {i} * 13 + {loc} * 5) % 12 AS DECIMAL(18,6)) AS crqtr
FROM part{where}"""
DOMAIN_SQL["l_mlpr"] = "\n" + "\nUNION ALL ".join(
    _POSITION.format(i=i, k=k, loc=loc, plate=plate, where=where)
    for i in (0, 1)
    for k, loc, plate, where in (
        (0, 0, "p_partkey", ""),
        (1, 1, "CASE WHEN p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END", " WHERE p_type = 'LARGE'"),
        (2, 0, "p_partkey", " WHERE p_type = 'SMALL'"),
    )
)

DOMAIN_SQL["x_ghost"] = """
SELECT s_suppkey AS id, CASE WHEN s_acctbal < 3000 THEN 0 ELSE 1 END AS cutperformed FROM supplier"""

DOMAIN_SQL["x_ghost_details"] = """
SELECT DISTINCT l_suppkey AS ghostid,
  CASE WHEN l_returnflag = 'R' AND l_discount > CAST(0.095 AS DOUBLE) THEN l_partkey * 100 ELSE -1 - l_partkey END AS trackingid
FROM lineitem"""

DOMAIN_SQL["workplanjobssheets"] = """
SELECT DISTINCT l_orderkey AS workplanid, l_partkey * 100 AS storelocationparttrackingid FROM lineitem"""

DOMAIN_SQL["xt_lista_di_prelievo"] = """
SELECT s_suppkey AS id,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE (SELECT min(o_orderdate) FROM orders) END AS datacreazione,
  ' op' || CAST(s_nationkey % 20 AS STRING) AS operatore,
  CASE s_nationkey % 6 WHEN 0 THEN 'Aperta' WHEN 1 THEN ' completata ' WHEN 2 THEN NULL
       WHEN 3 THEN 'closed' WHEN 4 THEN '' ELSE 'In corso' END AS stato
FROM supplier"""

DOMAIN_SQL["xt_lista_di_prelievo_righe"] = """
SELECT DISTINCT l_suppkey AS idlista, l_orderkey AS idnesting FROM lineitem"""

# One request per order; the priority decides which kind of input the request carries.
DOMAIN_SQL["requests"] = f"""
SELECT o_orderkey AS request_id,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'L' || lpad({_half('o_orderkey', 4)}, 9, '0')
       WHEN o_orderpriority = '2-HIGH' OR (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')
         THEN lpad({_half('o_orderkey', 2)}, 10, '0') ELSE NULL END AS job_ticket_code,
  CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderkey
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN o_orderkey ELSE NULL END AS nesting_id,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'N-none'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'N-' || {_half('o_orderkey', 3)} ELSE NULL END AS nesting_code,
  CASE WHEN o_orderpriority = '5-LOW' THEN k.crcod ELSE NULL END AS tracking_code,
  o_orderstatus = 'P' AS only_available
FROM orders
LEFT JOIN (SELECT conum, min(lead_part) AS lead_part FROM order_line GROUP BY conum) AS l ON l.conum = o_orderkey
LEFT JOIN s_crn k ON k.idcrn = CASE WHEN o_totalprice < 300000 THEN l.lead_part ELSE o_custkey END * 10
                              + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END"""

DOMAIN_SQL["request_jobs"] = """
SELECT o_orderkey AS request_id, conum * 100 + locod AS job_id
FROM orders JOIN order_line ON conum = o_orderkey WHERE o_orderpriority = '4-NOT SPECIFIED'"""

DOMAIN_SQL["plan_changes"] = """
SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS seq, user_id * 101 + event_id % 100 AS idnes,
  CASE event_type WHEN 'view' THEN substring(CAST(ts AS STRING), 1, 10)
    WHEN 'click' THEN substring(CAST(ts AS STRING), 1, 10) || 'T' || substring(CAST(ts AS STRING), 12, 5)
    WHEN 'purchase' THEN ' ' WHEN 'signup' THEN '31/12/2024' ELSE NULL END AS dtexp,
  CASE WHEN event_type = 'error' THEN NULL ELSE 'changed by ' || event_type END AS nsnot
FROM events"""

DOMAIN_SQL["operator_changes"] = """
SELECT event_id AS seq, lpad(CAST(user_id * 50 + event_id % 50 AS STRING), 10, '0') AS ticket,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'M' || CAST(event_id % 7 AS STRING) || ' ' END AS machine,
  CASE WHEN event_type = 'signup' THEN ' ' ELSE 'OP' || CAST(user_id % 20 AS STRING) END AS operator
FROM events"""

DOMAIN_SQL["scans"] = """
SELECT event_id AS seq, ts, user_id AS list_id,
  lpad(CAST(user_id * 50 + event_id % 60 AS STRING), 10, '0') AS ticket FROM events"""

DOMAIN_SQL["row_adds"] = """
SELECT user_id AS list_id, user_id * 101 + event_id % 100 AS idnes FROM events"""

DOMAIN_SQL["row_removes"] = """
SELECT DISTINCT l_suppkey AS list_id, l_orderkey AS idnes FROM lineitem WHERE l_returnflag = 'R'"""

DOMAIN_SQL["list_deletes"] = """
SELECT s_suppkey AS list_id,
  CASE s_nationkey % 3 WHEN 0 THEN 'OP' || CAST(s_nationkey % 20 AS STRING) || ' ' WHEN 1 THEN 'OP99' ELSE ' ' END AS operator
FROM supplier"""

DOMAIN_SQL["new_lists"] = """
SELECT CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_id END AS seq, CASE WHEN event_type = 'error' THEN ' ' ELSE ' OP' || CAST(user_id % 20 AS STRING) END AS operator,
  CASE event_type WHEN 'view' THEN 'In corso ' WHEN 'click' THEN '' ELSE NULL END AS state, ts AS created_at
FROM events"""

DOMAIN_SQL["lookup_keys"] = """
SELECT lpad(CAST(user_id * 50 + event_id % 50 AS STRING), 10, '0') AS key FROM events
UNION SELECT 'N-' || CAST(user_id * 33 + event_id % 40 AS STRING) AS key FROM events"""

# Searches: last digits of tickets, some with a wildcard or of two characters; a few words; blanks; one operator each or none.
DOMAIN_SQL["searches"] = """
SELECT event_id AS search_id, CASE WHEN event_id % 5000 = 7 THEN ' ' WHEN event_id % 5000 = 8 THEN NULL
    WHEN event_id % 2500 = 9 THEN '%ASI_' WHEN event_id % 2500 = 10 THEN 'GH' WHEN event_id % 2500 = 11 THEN ' E_R '
    WHEN event_id % 2500 = 12 THEN 'no such text' WHEN event_id % 2500 = 13 THEN 'N 2-H%GH'
    WHEN event_id % 10 = 1 THEN substring(t, 6, 2) || '_' || substring(t, 9, 2)
    WHEN event_id % 10 = 2 THEN substring(t, 5, 3) || '%' || substring(t, 9, 2)
    ELSE substring(t, 6, 5) END AS search,
  CASE WHEN event_id % 20 = 3 THEN ' OP' || CAST(user_id % 20 AS STRING) ELSE NULL END AS operator
FROM (SELECT event_id, user_id, lpad(CAST(user_id * 50 + event_id % 60 AS STRING), 10, '0') AS t FROM events) AS e"""

# Each list asks for a word, some for digits of a ticket.
DOMAIN_SQL["list_searches"] = f"""
SELECT s_suppkey AS list_id, CASE s_nationkey % 5 WHEN 0 THEN 'PLATE' WHEN 1 THEN ' N-1' WHEN 2 THEN '_7%'
  WHEN 3 THEN '' ELSE lpad({_half('s_suppkey', 1)}, 3, '0') END AS search FROM supplier
UNION ALL SELECT s_suppkey AS list_id, 'PLATE A' AS search FROM supplier WHERE s_nationkey % 5 > 2"""

# Dirty ERP columns: the same fact arrives as timestamp text, yyyyMMdd text or number, clock text, localized decimals.
DOMAIN_SQL["erp_dirty"] = """
SELECT event_id AS id,
  CASE event_type WHEN 'view' THEN replace(substring(CAST(ts AS STRING), 1, 10), '-', '')
    WHEN 'click' THEN substring(CAST(ts AS STRING), 1, 19) WHEN 'purchase' THEN substring(CAST(ts AS STRING), 1, 10)
    WHEN 'signup' THEN 'n/a' ELSE NULL END AS due,
  20240100 + CAST(event_id % 40 AS INT) AS due_number,
  CASE event_id % 9 WHEN 0 THEN ' 1.5 ' WHEN 1 THEN '1,5' WHEN 2 THEN '1.234,5' WHEN 3 THEN CAST(user_id AS STRING) || ':30'
    WHEN 4 THEN '1:30:36' WHEN 5 THEN '1.02:15' WHEN 6 THEN 'abc' WHEN 7 THEN '-' || CAST(user_id AS STRING) ELSE NULL END AS hours,
  CASE event_id % 4 WHEN 0 THEN ' 42' WHEN 1 THEN '-' || CAST(user_id AS STRING) WHEN 2 THEN '4.2' ELSE NULL END AS pieces,
  CAST(value AS DECIMAL(18,3)) AS amount
FROM events"""


def register_view(spark: SparkSession, sf_dir: str, name: str, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """Temp view of one domain table and of the tables it reads.

    ``shared`` keeps the tables of :data:`SHARED` between calls for one data folder: they are written to the stage
    folder when they are first read, instead of being worked out again inside each of their readers.
    """
    shared = {} if shared is None else shared
    for table in needed_by([name]):
        if table in DRIVER_TABLES:
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        elif table in SHARED:
            if table not in shared:
                # Dealt by order once, for the lines of an order as well as for what is said of the whole order.
                spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
                    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey").createOrReplaceTempView("lineitem")
                shared[table] = stage(spark.sql(DOMAIN_SQL[table]), table)
                spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
            df = shared[table]
        else:
            df = spark.sql(DOMAIN_SQL[table])
        df.createOrReplaceTempView(table)
    return spark.table(name)


def needed_by(names: list[str] | tuple[str, ...]) -> list[str]:
    """The named tables and whatever they read, readers last."""
    found: list[str] = []

    def visit(name: str) -> None:
        for other in (*DRIVER_TABLES, *DOMAIN_SQL):
            if other != name and other not in found and name in DOMAIN_SQL and _reads(DOMAIN_SQL[name], other):
                visit(other)
        if name not in found:
            found.append(name)

    for n in names:
        visit(n)
    return found


def with_prefix(names: list[str] | tuple[str, ...]) -> str:
    """``name AS (...)`` list for the named domain tables and the domain tables they read."""
    return ",\n".join(f"{n} AS ({DOMAIN_SQL[n]})" for n in needed_by(names) if n in DOMAIN_SQL)


def _reads(sql: str, table: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(w.upper() in ("FROM", "JOIN") and nxt == table for w, nxt in zip(words, words[1:]))
