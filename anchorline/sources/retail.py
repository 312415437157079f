"""Clinical-shaped views over the retail test tables (see FIXTURES.md §3).

Orders stand for admissions, customers for patients and line items for events.
Every view is a lazy projection over the whole tables and exercises NULLs,
window edges, error marks and unknown items.  Remainders of keys only spread
values, and decide which admissions have an ICU stay without a time or a second
one; every query runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.staging import staged, stored_bytes
from .tables import ClinicalTables

INFUSION_ITEMS = [221906, 30047, 222168, 30131, 221289, 221668, 999, 998]
CHART_ITEMS = [
    211, 51, 920, 3485, 762, 3581, 467, 223848, 223849, 60,
    152, 8368, 456, 618, 646, 807, 223762, 676, 223761, 999,
]
LAB_ITEMS = [
    50868, 50862, 50882, 50885, 50912, 50902, 50931, 51221, 51222, 50813, 50960,
    50970, 51265, 50971, 51275, 51237, 51274, 50983, 51006, 51301, 999,
]
PROCEDURE_ITEMS = [225802, 225803, 225441, 999]
VISIT = ["o_custkey AS subject_id", "l_orderkey AS hadm_id"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
]
# Stored bytes of line items (some 300,000 rows) that one task of their join takes, and
# the number of tasks up to which the session's partitions do.
TASK_BYTES = 4 << 20
FEW_TASKS = 8


# Declared, so that opening a table starts no job to look into its files.
RETAIL_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RETAIL_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: str, name: str) -> str:
    """The value at ``index`` of a constant array."""
    items = ", ".join(
        "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values
    )
    return f"element_at(array({items}), CAST({index} AS INT) + 1) AS {name}"


def _hours_after(time: str, amount: str, name: str) -> str:
    return f"{time} + INTERVAL '1' HOUR * CAST({amount} AS INT) AS {name}"


def _event_time(amount: str, name: str = "charttime") -> str:
    return _hours_after("o_orderdate", f"({amount}) % 72 - 6", name)


def _admissions(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_custkey AS subject_id",
        "o_orderkey AS hadm_id",
        "o_orderdate AS admittime",
        _hours_after("o_orderdate", "(o_orderkey * 37) % 400", "dischtime"),
        """CASE WHEN o_orderkey % 17 = 0 THEN NULL
                WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
                WHEN o_orderpriority = '2-HIGH' THEN 'EMERGENCY'
                WHEN o_orderpriority = '5-LOW' THEN 'Elective'
                ELSE o_orderpriority END AS admission_type""",
        _pick(
            [
                "EMERGENCY ROOM ADMIT", "clinic referral/premature",
                "TRANSFER FROM HOSP/EXTRAM", " PHYS REFERRAL/NORMAL DELI", None, "UNMAPPED WING",
            ],
            "o_orderkey % 6",
            "admission_location",
        ),
        _pick(
            ["Medicare", "PRIVATE", "medicaid", "Self Pay", "SELF_PAY", None],
            "(o_orderkey + o_custkey) % 6",
            "insurance",
        ),
        _pick(["ENGL", "span", "*URD", None, "RUSS"], "o_custkey % 5", "language"),
        _pick(
            ["CATHOLIC", "Not_Specified", "NOT SPECIFIED", "OTHER", "jewish", None, "BUDDHIST"],
            "o_orderkey % 7",
            "religion",
        ),
        _pick(
            ["MARRIED", "single", "WIDOWED", "LIFE PARTNER", None],
            "(o_custkey * 3) % 5",
            "marital_status",
        ),
        _pick(
            [
                "WHITE", "black_african_american", "ASIAN - CHINESE", "ASIAN_CHINESE",
                "OTHER", None, "HISPANIC_OR_LATINO",
            ],
            "(o_orderkey * 5) % 7",
            "ethnicity",
        ),
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate - INTERVAL '1' HOUR END AS edregtime",
        "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS has_chartevents_data",
    )


def _patients(customer: DataFrame, orders: DataFrame) -> DataFrame:
    first_order = orders.groupBy("o_custkey").agg({"o_orderdate": "min"})
    return customer.join(
        first_order.toDF("c_custkey", "t0"), "c_custkey", "left"
    ).selectExpr(
        "c_custkey AS subject_id",
        "c_mktsegment AS gender",
        "TIMESTAMP_NTZ '1905-01-01 00:00:00'"
        " + INTERVAL '1' DAY * CAST((c_custkey * 211) % 33000 AS INT) AS dob",
        "CASE WHEN c_custkey % 3 = 0"
        " THEN t0 + INTERVAL '1' DAY * CAST((c_custkey * 17) % 60 AS INT) END AS dod",
    )


def _icustays(orders: DataFrame) -> DataFrame:
    # a third of the admissions have a stay without a time
    timed = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END"
    first = orders.selectExpr(
        "o_orderkey AS hadm_id", _hours_after(timed, "(o_orderkey * 29) % 90 - 6", "intime")
    )
    second = orders.where("o_orderkey % 6 = 1").selectExpr(
        "o_orderkey AS hadm_id", _hours_after("o_orderdate", "(o_orderkey * 31) % 90", "intime")
    )
    return first.unionByName(second)


# Event tables: the rows of line items they take, and their columns.
_EVENTS = {
    "chartevents": (
        "true",
        [
            _event_time("l_partkey * 7 + l_linenumber * 13"),
            _pick(CHART_ITEMS, "(l_partkey + l_suppkey) % 20", "itemid"),
            "CASE WHEN l_linenumber <> 7 THEN l_quantity * 3 END AS valuenum",
            _pick(["Ventilator", "Other", "None", None], "l_partkey % 4", "value"),
            """CASE WHEN l_returnflag = 'A' THEN 1
                    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL
                    ELSE 0 END AS error""",
        ],
    ),
    "inputevents_cv": (
        "l_linenumber % 2 = 1",
        [_event_time("l_partkey * 3"), _pick(INFUSION_ITEMS, "l_partkey % 8", "itemid")],
    ),
    "inputevents_mv": (
        "l_linenumber % 2 = 0",
        [
            _event_time("l_partkey * 5", "starttime"),
            _pick(INFUSION_ITEMS, "(l_partkey + 3) % 8", "itemid"),
        ],
    ),
    "prescriptions": (
        "true",
        [
            _event_time("l_partkey * 13", "startdate"),
            _pick(
                [
                    "Vancomycin", "ZOSYN 4.5g", "Piperacillin/Tazobactam", "Aspirin",
                    None, "Heparin", "cefepime HCl", "Insulin",
                ],
                "l_suppkey % 8",
                "drug",
            ),
        ],
    ),
    "procedureevents_mv": (
        "true",
        [
            _event_time("l_partkey * 17", "starttime"),
            # most procedures are on no list
            _pick(PROCEDURE_ITEMS, "CASE WHEN l_linenumber = 3 THEN l_partkey % 4 ELSE 3 END", "itemid"),
        ],
    ),
    "microbiologyevents": (
        "true",
        [
            _pick(
                ["Blood Culture", "BLOOD CULTURE (MYCO)", "URINE", None],
                "l_partkey % 4",
                "spec_type_desc",
            ),
            _pick(["E. coli", None, "STAPH"], "l_suppkey % 3", "org_name"),
            _event_time("l_partkey * 19"),
        ],
    ),
    "labevents": (
        "true",
        [
            _event_time("l_partkey * 11 + l_linenumber * 5"),
            _pick(LAB_ITEMS, "(l_partkey + l_suppkey) % 21", "itemid"),
            "CASE WHEN l_linenumber <> 7 THEN l_quantity END AS valuenum",
        ],
    ),
}


def clinical_tables(spark: SparkSession, sf_dir: str, folder: str | None = None) -> ClinicalTables:
    """The ten tables.  With ``folder`` the join behind the event tables is written there once.

    A reader of several event tables otherwise joins the line items once for each.
    """
    opened: dict[str, DataFrame] = {}

    def once(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in opened:
            opened[name] = build()
        return opened[name]

    def source(name: str) -> DataFrame:
        return once(name, lambda: read_table(spark, sf_dir, name))

    def lines() -> DataFrame:
        """Line items with the customer and date of their order."""
        orders = source("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderdate")
        rows = source("lineitem").select(*LINE_COLUMNS)
        # sorted rows of a task grow with the table if the number of tasks is fixed
        tasks = -(-stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // TASK_BYTES)
        if tasks > FEW_TASKS:
            rows, orders = (side.repartition(tasks, "l_orderkey") for side in (rows, orders))
        joined = rows.join(orders, "l_orderkey")
        return joined if folder is None else staged(joined, folder, "lines")

    def open_table(name: str) -> DataFrame:
        if name == "admissions":
            return _admissions(source("orders"))
        if name == "patients":
            return _patients(source("customer"), source("orders"))
        if name == "icustays":
            return _icustays(source("orders"))
        rows, columns = _EVENTS[name]
        return once("lines", lines).where(rows).selectExpr(*VISIT, *columns)

    return ClinicalTables(open_table)


def subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a requested subject."""
    return read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS subject_id")
