"""ANSI SQL (DuckDB dialect) for every registered query, on the same whole tables.

Written apart from the Spark plans: one join per feature against the
admissions, membership by IN, windows without shortcuts.
"""

from __future__ import annotations

from .. import fixed_values as fv
from ..plans.scoring import PROBABILITY_COLUMNS
from ..sources.schemas import COHORT_COLUMNS, FEATURE_COLUMNS, MEASURE_COLUMNS, TARGET_COLUMNS
from .queries import LOGISTIC_MODELS


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _bounds(rows) -> str:
    values = ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, lo, hi in rows)
    return f"SELECT * FROM (VALUES {values}) AS b(itemid, lo, hi)"


def _pick(values: list, index: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{items}], CAST({index} AS INT) + 1)"


def _hours(time: str, amount: str) -> str:
    return f"{time} + to_hours(CAST({amount} AS INT))"


def _enum(column: str, words) -> str:
    return (
        f"CASE WHEN upper({column}) IN {_list(words)} THEN upper({column}) "
        f"ELSE '{fv.OTHER_CATEGORY}' END AS {column}"
    )


_INFUSIONS = [221906, 30047, 222168, 30131, 221289, 221668, 999, 998]
_CHART = [211, 51, 920, 3485, 762, 3581, 467, 223848, 223849, 60,
          152, 8368, 456, 618, 646, 807, 223762, 676, 223761, 999]
_LABS = [50868, 50862, 50882, 50885, 50912, 50902, 50931, 51221, 51222, 50813, 50960,
         50970, 51265, 50971, 51275, 51237, 51274, 50983, 51006, 51301, 999]
_VISIT = "o_custkey AS subject_id, l_orderkey AS hadm_id"


def _event_time(amount: str, name: str = "charttime") -> str:
    return _hours("o_orderdate", f"({amount}) % 72 - 6") + f" AS {name}"


# Clinical-shaped views over the retail tables.
_VIEWS = {
    "admissions": f"""
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
          {_hours('o_orderdate', '(o_orderkey * 37) % 400')} AS dischtime,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL
               WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
               WHEN o_orderpriority = '2-HIGH' THEN 'EMERGENCY'
               WHEN o_orderpriority = '5-LOW' THEN 'Elective'
               ELSE o_orderpriority END AS admission_type,
          {_pick(['EMERGENCY ROOM ADMIT', 'clinic referral/premature', 'TRANSFER FROM HOSP/EXTRAM',
                  ' PHYS REFERRAL/NORMAL DELI', None, 'UNMAPPED WING'], 'o_orderkey % 6')}
            AS admission_location,
          {_pick(['Medicare', 'PRIVATE', 'medicaid', 'Self Pay', 'SELF_PAY', None],
                 '(o_orderkey + o_custkey) % 6')} AS insurance,
          {_pick(['ENGL', 'span', '*URD', None, 'RUSS'], 'o_custkey % 5')} AS language,
          {_pick(['CATHOLIC', 'Not_Specified', 'NOT SPECIFIED', 'OTHER', 'jewish', None, 'BUDDHIST'],
                 'o_orderkey % 7')} AS religion,
          {_pick(['MARRIED', 'single', 'WIDOWED', 'LIFE PARTNER', None], '(o_custkey * 3) % 5')}
            AS marital_status,
          {_pick(['WHITE', 'black_african_american', 'ASIAN - CHINESE', 'ASIAN_CHINESE', 'OTHER',
                  None, 'HISPANIC_OR_LATINO'], '(o_orderkey * 5) % 7')} AS ethnicity,
          CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate - INTERVAL 1 HOUR END AS edregtime,
          CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS has_chartevents_data
        FROM orders""",
    "patients": """
        SELECT c_custkey AS subject_id, c_mktsegment AS gender,
          TIMESTAMP '1905-01-01' + to_days(CAST((c_custkey * 211) % 33000 AS INT)) AS dob,
          CASE WHEN c_custkey % 3 = 0
               THEN t0 + to_days(CAST((c_custkey * 17) % 60 AS INT)) END AS dod
        FROM customer
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS t0 FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey""",
    "icustays": f"""
        SELECT o_orderkey AS hadm_id,
          CASE WHEN o_orderkey % 3 <> 0
               THEN {_hours('o_orderdate', '(o_orderkey * 29) % 90 - 6')} END AS intime
        FROM orders
        UNION ALL
        SELECT o_orderkey, {_hours('o_orderdate', '(o_orderkey * 31) % 90')}
        FROM orders WHERE o_orderkey % 6 = 1""",
    "lo": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "chartevents": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 7 + l_linenumber * 13')},
          {_pick(_CHART, '(l_partkey + l_suppkey) % 20')} AS itemid,
          CASE WHEN l_linenumber <> 7 THEN l_quantity * 3 END AS valuenum,
          {_pick(['Ventilator', 'Other', 'None', None], 'l_partkey % 4')} AS value,
          CASE WHEN l_returnflag = 'A' THEN 1
               WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE 0 END AS error
        FROM lo""",
    "inputevents_cv": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 3')},
          {_pick(_INFUSIONS, 'l_partkey % 8')} AS itemid FROM lo WHERE l_linenumber % 2 = 1""",
    "inputevents_mv": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 5', 'starttime')},
          {_pick(_INFUSIONS, '(l_partkey + 3) % 8')} AS itemid FROM lo WHERE l_linenumber % 2 = 0""",
    "prescriptions": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 13', 'startdate')},
          {_pick(['Vancomycin', 'ZOSYN 4.5g', 'Piperacillin/Tazobactam', 'Aspirin', None,
                  'Heparin', 'cefepime HCl', 'Insulin'], 'l_suppkey % 8')} AS drug FROM lo""",
    "procedureevents_mv": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 17', 'starttime')},
          CASE WHEN l_linenumber = 3
               THEN {_pick([225802, 225803, 225441, 999], 'l_partkey % 4')} ELSE 999 END AS itemid
        FROM lo""",
    "microbiologyevents": f"""
        SELECT {_VISIT},
          {_pick(['Blood Culture', 'BLOOD CULTURE (MYCO)', 'URINE', None], 'l_partkey % 4')}
            AS spec_type_desc,
          {_pick(['E. coli', None, 'STAPH'], 'l_suppkey % 3')} AS org_name,
          {_event_time('l_partkey * 19')} FROM lo""",
    "labevents": f"""
        SELECT {_VISIT}, {_event_time('l_partkey * 11 + l_linenumber * 5')},
          {_pick(_LABS, '(l_partkey + l_suppkey) % 21')} AS itemid,
          CASE WHEN l_linenumber <> 7 THEN l_quantity END AS valuenum FROM lo""",
    "lab_bounds": _bounds(fv.LAB_BOUNDS),
    "vital_bounds": _bounds(fv.VITAL_BOUNDS),
}


def _elapsed(start: str, end: str, unit_seconds: int) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 1e6 / {unit_seconds}"


# Cohort selection, one step per relation.
_STEPS = {
    "base": """
        SELECT a.*, p.gender, p.dob, p.dod FROM admissions a
        JOIN patients p ON a.subject_id = p.subject_id
        WHERE a.subject_id IN (SELECT c_custkey FROM customer)""",
    "ordered": """
        SELECT *, lead(admittime) OVER w AS next_admittime, row_number() OVER w AS rn
        FROM base
        WINDOW w AS (PARTITION BY subject_id ORDER BY admittime ASC NULLS LAST, hadm_id)""",
    "derived": f"""
        SELECT *, {_elapsed('dob', 'admittime', fv.SECONDS_PER_YEAR)} AS admission_age,
          {_elapsed('admittime', 'dischtime', fv.SECONDS_PER_HOUR)} AS los_hours,
          dod IS NOT NULL AND coalesce(
            {_elapsed('admittime', 'dod', fv.SECONDS_PER_HOUR)} < {fv.MIN_LOS_HOURS}, FALSE)
            AS died_before_min_window
        FROM ordered WHERE rn = 1""",
    "judged": f"""
        SELECT *,
          coalesce(admission_age BETWEEN {fv.MIN_AGE} AND {fv.MAX_AGE}, FALSE) AS ok_age,
          coalesce(los_hours >= {fv.MIN_LOS_HOURS}, FALSE) AS ok_length_of_stay,
          coalesce(has_chartevents_data = 1, FALSE) AS ok_charted,
          NOT died_before_min_window AS ok_survived
        FROM derived""",
    "chosen": """
        SELECT * FROM judged WHERE ok_age AND ok_length_of_stay AND ok_charted AND ok_survived""",
    "outcomes": f"""
        SELECT subject_id, hadm_id,
          CASE WHEN dod <= dischtime + INTERVAL {fv.MORTALITY_DAYS} DAY THEN 1 ELSE 0 END
            AS mortality,
          CASE WHEN epoch_us(dischtime) - epoch_us(admittime)
                    > {fv.PROLONGED_LOS_DAYS}::BIGINT * 86400000000 THEN 1 ELSE 0 END
            AS prolonged_los,
          CASE WHEN next_admittime <= dischtime + INTERVAL {fv.READMISSION_DAYS} DAY
               THEN 1 ELSE 0 END AS readmission_30d
        FROM chosen""",
    "cohort13": f"""
        SELECT subject_id, hadm_id, admittime,
          {', '.join(_enum(k, v) for k, v in fv.VOCABULARIES.items())},
          edregtime, gender, admission_age
        FROM chosen""",
    "members": "SELECT hadm_id FROM chosen",
}


def _in_window(table: str, time: str, condition: str, keys: str = "both") -> str:
    """FROM/WHERE of events of cohort admissions within the window."""
    on = "e.hadm_id = a.hadm_id" + (" AND e.subject_id = a.subject_id" if keys == "both" else "")
    return f"""FROM {table} e JOIN chosen a ON {on}
        WHERE e.{time} BETWEEN a.admittime AND a.admittime + INTERVAL {fv.WINDOW_HOURS} HOUR
          AND {condition}"""


def _first_reading(name: str, items, factor_items, factor) -> str:
    rows = _in_window(
        "chartevents", "charttime",
        f"e.itemid IN {_list(items)} AND e.valuenum IS NOT NULL AND e.error = 0",
    )
    return f"""
        SELECT hadm_id, {name} FROM (
          SELECT e.hadm_id,
            CASE WHEN e.itemid IN {_list(factor_items)} THEN e.valuenum * {factor}::DOUBLE
                 ELSE e.valuenum END AS {name},
            row_number() OVER (PARTITION BY e.hadm_id
                               ORDER BY e.charttime, e.itemid, e.valuenum) AS rn
          {rows}) WHERE rn = 1"""


_VENT_SETTINGS = _list(fv.VENT_SETTING_ITEMS + fv.PEEP_ITEMS + fv.TIDAL_VOLUME_ITEMS)


def _ventilation(prefix: str = "") -> str:
    text = f"lower(coalesce({prefix}value, ''))"
    return (
        f"{prefix}error = 0 AND ({prefix}itemid IN {_VENT_SETTINGS}"
        f" OR ({prefix}itemid = 467 AND {text} LIKE '%ventilator%')"
        f" OR ({prefix}itemid = 223848 AND {text} NOT LIKE '%other%'))"
    )


def _antibiotic(prefix: str = "") -> str:
    return f"regexp_matches(lower(coalesce({prefix}drug, '')), '{'|'.join(fv.ANTIBIOTIC_KEYWORDS)}')"


def _culture(prefix: str = "") -> str:
    return (
        f"lower(coalesce({prefix}spec_type_desc, '')) LIKE '%blood culture%'"
        f" AND {prefix}org_name IS NOT NULL"
    )


def _infused(items) -> str:
    on_list = f"e.itemid IN {_list(items)}"
    return f"""SELECT e.hadm_id {_in_window('inputevents_cv', 'charttime', on_list)}
        UNION ALL SELECT e.hadm_id {_in_window('inputevents_mv', 'starttime', on_list)}"""


_PROC_RRT = _list(fv.RRT_PROCEDURE_ITEMS)
_CHART_RRT = _list(fv.RRT_CHART_ITEMS)

_FEATURES = {
    "icu": f"""
        SELECT e.hadm_id, min(e.intime) AS first_icu_intime
        {_in_window('icustays', 'intime', 'TRUE', keys='hadm_id')} GROUP BY e.hadm_id""",
    "heights": _first_reading(
        "height_cm", fv.HEIGHT_INCH_ITEMS + fv.HEIGHT_CM_ITEMS, fv.HEIGHT_INCH_ITEMS, fv.CM_PER_INCH
    ),
    "weights": _first_reading(
        "weight_kg", fv.WEIGHT_KG_ITEMS + fv.WEIGHT_LB_ITEMS, fv.WEIGHT_LB_ITEMS, fv.KG_PER_LB
    ),
    "vasopressors": _infused(fv.VASOPRESSOR_ITEMS),
    "sedations": _infused(fv.SEDATION_ITEMS),
    "antibiotics": f"SELECT e.hadm_id {_in_window('prescriptions', 'startdate', _antibiotic('e.'))}",
    "ventilations": f"SELECT e.hadm_id {_in_window('chartevents', 'charttime', _ventilation('e.'))}",
    "rrts": f"""
        SELECT e.hadm_id {_in_window('procedureevents_mv', 'starttime', f'e.itemid IN {_PROC_RRT}')}
        UNION ALL
        SELECT e.hadm_id {_in_window('chartevents', 'charttime',
                                     f'e.itemid IN {_CHART_RRT} AND e.error = 0')}""",
    "cultures": f"SELECT e.hadm_id {_in_window('microbiologyevents', 'charttime', _culture('e.'))}",
    "labs": f"""
        SELECT l.* FROM (
          SELECT e.subject_id, e.hadm_id, e.charttime, e.itemid, e.valuenum
          {_in_window('labevents', 'charttime', 'e.valuenum IS NOT NULL')}) l
        JOIN lab_bounds b ON l.itemid = b.itemid AND l.valuenum >= b.lo AND l.valuenum <= b.hi""",
    "vitals": f"""
        SELECT v.* FROM (
          SELECT e.subject_id, e.hadm_id, e.charttime, e.itemid, e.valuenum
          {_in_window('chartevents', 'charttime', 'e.valuenum IS NOT NULL AND e.error = 0')}) v
        JOIN vital_bounds b ON v.itemid = b.itemid AND v.valuenum >= b.lo AND v.valuenum <= b.hi""",
}


def _flag(events: str, name: str) -> str:
    return f"CASE WHEN hadm_id IN (SELECT hadm_id FROM {events}) THEN 1 ELSE 0 END AS {name}"


_FLAGS = {
    "received_vasopressor": "vasopressors",
    "received_sedation": "sedations",
    "received_antibiotic": "antibiotics",
    "was_mechanically_ventilated": "ventilations",
    "received_rrt": "rrts",
    "positive_blood_culture": "cultures",
}
_WIDE = {
    "wide": f"""
        SELECT c.*, i.first_icu_intime, h.height_cm, w.weight_kg,
          {', '.join(_flag(events, name).replace('hadm_id IN', 'c.hadm_id IN', 1)
                     for name, events in _FLAGS.items())}
        FROM cohort13 c LEFT JOIN icu i ON c.hadm_id = i.hadm_id
        LEFT JOIN heights h ON c.hadm_id = h.hadm_id
        LEFT JOIN weights w ON c.hadm_id = w.hadm_id"""
}

_RELATIONS = {**_VIEWS, **_STEPS, **_FEATURES, **_WIDE}
_PREAMBLE = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _RELATIONS.items())

_IDS = "subject_id, hadm_id"
_ATTRITION = """
    SELECT 'listed' AS step, count(c_custkey) AS n FROM customer
    UNION ALL SELECT 'admissions', count(*) FROM base
    UNION ALL SELECT 'repeated_patients', count(*) - count(DISTINCT subject_id)
      FROM patients WHERE subject_id IS NOT NULL
    UNION ALL SELECT 'candidates', count(*) FROM judged
    UNION ALL SELECT 'passed:age', count(*) FROM judged WHERE ok_age
    UNION ALL SELECT 'passed:length_of_stay', count(*) FROM judged WHERE ok_length_of_stay
    UNION ALL SELECT 'passed:charted', count(*) FROM judged WHERE ok_charted
    UNION ALL SELECT 'passed:survived', count(*) FROM judged WHERE ok_survived
    UNION ALL SELECT 'kept', count(*) FROM chosen
    UNION ALL SELECT 'excluded', count(*) FROM judged WHERE hadm_id NOT IN (SELECT hadm_id FROM members)
    UNION ALL SELECT 'excluded:age', count(*) FROM judged
      WHERE hadm_id NOT IN (SELECT hadm_id FROM members) AND NOT ok_age
    UNION ALL SELECT 'excluded:length_of_stay', count(*) FROM judged
      WHERE hadm_id NOT IN (SELECT hadm_id FROM members) AND NOT ok_length_of_stay
    UNION ALL SELECT 'excluded:charted', count(*) FROM judged
      WHERE hadm_id NOT IN (SELECT hadm_id FROM members) AND NOT ok_charted
    UNION ALL SELECT 'excluded:survived', count(*) FROM judged
      WHERE hadm_id NOT IN (SELECT hadm_id FROM members) AND NOT ok_survived"""

_ROW_COUNTS = """
    SELECT 'cohort' AS output, count(*) AS row_count FROM wide
    UNION ALL SELECT 'labs', count(*) FROM labs
    UNION ALL SELECT 'vitals', count(*) FROM vitals
    UNION ALL SELECT 'targets', count(*) FROM outcomes"""

_MEASURE = "subject_id, hadm_id, charttime, itemid, valuenum"


def _readings(items, name: str, factor_items, factor) -> str:
    return f"""SELECT {_IDS}, charttime AS event_time, itemid, valuenum,
          CASE WHEN itemid IN {_list(factor_items)} THEN valuenum * {factor}::DOUBLE
               ELSE valuenum END AS {name}
        FROM chartevents
        WHERE itemid IN {_list(items)} AND error = 0 AND valuenum IS NOT NULL"""


def _visit_feature(relation: str, name: str) -> str:
    return f"""SELECT c.subject_id, c.hadm_id, f.{name} FROM chosen c
        LEFT JOIN {relation} f ON c.hadm_id = f.hadm_id"""


def _head(relation: str, order: str) -> str:
    return f"SELECT * FROM {relation} ORDER BY {order} LIMIT 5"


_SELECTS = {
    "base_admissions": "SELECT * FROM base",
    "subject_membership": f"""SELECT {_IDS}, admittime FROM admissions
        WHERE subject_id IN (SELECT user_id FROM events)""",
    "next_admission": f"""SELECT {_IDS}, admittime, lead(admittime) OVER (
          PARTITION BY subject_id ORDER BY admittime ASC NULLS LAST, hadm_id) AS next_admittime
        FROM admissions""",
    "first_admission": f"SELECT {_IDS}, admittime, next_admittime FROM ordered WHERE rn = 1",
    "derived_columns": f"""SELECT {_IDS}, admission_age, los_hours, died_before_min_window
        FROM derived""",
    "cohort": "SELECT * FROM cohort13",
    "cohort_from_base": "SELECT * FROM cohort13",
    "targets": "SELECT * FROM outcomes",
    "label_mortality": f"SELECT {_IDS}, mortality FROM outcomes",
    "label_prolonged_los": f"SELECT {_IDS}, prolonged_los FROM outcomes",
    "label_readmission": f"SELECT {_IDS}, readmission_30d FROM outcomes",
    "attrition": _ATTRITION,
    "excluded": f"""SELECT {_IDS}, ok_age, ok_length_of_stay, ok_charted, ok_survived FROM judged
        WHERE hadm_id NOT IN (SELECT hadm_id FROM members)""",
    "normalize_enums": f"""SELECT {_IDS},
        {', '.join(_enum(k, v) for k, v in fv.VOCABULARIES.items())} FROM admissions""",
    "anchor_window": f"""SELECT e.subject_id, e.hadm_id, e.charttime, e.itemid, e.valuenum
        {_in_window('chartevents', 'charttime', 'TRUE')}""",
    "first_icu_intime": _visit_feature("icu", "first_icu_intime"),
    "first_height": _visit_feature("heights", "height_cm"),
    "first_weight": _visit_feature("weights", "weight_kg"),
    "flag_vasopressor": f"SELECT {_IDS}, {_flag('vasopressors', 'received_vasopressor')} FROM chosen",
    "flag_sedation": f"SELECT {_IDS}, {_flag('sedations', 'received_sedation')} FROM chosen",
    "flag_antibiotic": f"SELECT {_IDS}, {_flag('antibiotics', 'received_antibiotic')} FROM chosen",
    "flag_ventilated":
        f"SELECT {_IDS}, {_flag('ventilations', 'was_mechanically_ventilated')} FROM chosen",
    "flag_rrt": f"SELECT {_IDS}, {_flag('rrts', 'received_rrt')} FROM chosen",
    "flag_blood_culture": f"SELECT {_IDS}, {_flag('cultures', 'positive_blood_culture')} FROM chosen",
    "height_readings": _readings(
        fv.HEIGHT_INCH_ITEMS + fv.HEIGHT_CM_ITEMS, "height_cm", fv.HEIGHT_INCH_ITEMS, fv.CM_PER_INCH
    ),
    "weight_readings": _readings(
        fv.WEIGHT_KG_ITEMS + fv.WEIGHT_LB_ITEMS, "weight_kg", fv.WEIGHT_LB_ITEMS, fv.KG_PER_LB
    ),
    "ventilation_events": f"""SELECT {_IDS}, charttime AS event_time FROM chartevents
        WHERE {_ventilation()}""",
    "infusion_events": f"""
        SELECT {_IDS}, charttime AS event_time, itemid FROM inputevents_cv
        WHERE itemid IN {_list(fv.VASOPRESSOR_ITEMS + fv.SEDATION_ITEMS)}
        UNION ALL SELECT {_IDS}, starttime, itemid FROM inputevents_mv
        WHERE itemid IN {_list(fv.VASOPRESSOR_ITEMS + fv.SEDATION_ITEMS)}""",
    "antibiotic_orders": f"""SELECT {_IDS}, startdate AS event_time FROM prescriptions
        WHERE {_antibiotic()}""",
    "rrt_events": f"""
        SELECT {_IDS}, starttime AS event_time FROM procedureevents_mv WHERE itemid IN {_PROC_RRT}
        UNION ALL SELECT {_IDS}, charttime FROM chartevents
        WHERE itemid IN {_CHART_RRT} AND error = 0""",
    "positive_cultures": f"""SELECT {_IDS}, charttime AS event_time FROM microbiologyevents
        WHERE {_culture()}""",
    "plausible_labs": f"""SELECT l.{_MEASURE.replace(', ', ', l.')} FROM labevents l
        JOIN lab_bounds b ON l.itemid = b.itemid WHERE l.valuenum BETWEEN b.lo AND b.hi""",
    "plausible_vitals": f"""SELECT v.{_MEASURE.replace(', ', ', v.')} FROM chartevents v
        JOIN vital_bounds b ON v.itemid = b.itemid WHERE v.valuenum BETWEEN b.lo AND b.hi""",
    "labs_48h": "SELECT * FROM labs",
    "labs_48h_shuffled": "SELECT * FROM labs",
    "labs_48h_clustered": "SELECT * FROM labs",
    "vitals_48h_clustered": "SELECT * FROM vitals",
    "vitals_48h": "SELECT * FROM vitals",
    "cohort_features": "SELECT * FROM wide",
    "extract_cohort": "SELECT * FROM wide",
    "extract_vitals": "SELECT * FROM vitals",
    "extract_labs": "SELECT * FROM labs",
    "extract_targets": "SELECT * FROM outcomes",
    "extract_attrition": _ATTRITION,
    "result_row_counts": _ROW_COUNTS,
    "job_row_counts": _ROW_COUNTS,
    "job_cohort_sample": _head("wide", _IDS),
    "job_labs_sample": _head("labs", _MEASURE),
    "stored_tables": "SELECT * FROM wide",
    "cohort_head": _head("wide", _IDS),
    "targets_head": _head("outcomes", _IDS),
    "labs_head": _head("labs", _MEASURE),
    "vitals_head": _head("vitals", _MEASURE),
    "subjects_from_csv": f"SELECT {_IDS}, admittime FROM base",
    "bounds_from_csv": "SELECT * FROM labs",
    "csv_roundtrip": "SELECT * FROM outcomes",
    "score_unseen": """SELECT subject_id,
          admission_age / 200::DOUBLE + 0.25::DOUBLE * was_mechanically_ventilated
            AS mortality_proba,
          0.25::DOUBLE * (received_vasopressor + received_sedation + received_rrt)
            AS prolonged_LOS_proba,
          0.125::DOUBLE + 0.5::DOUBLE * received_antibiotic AS readmission_proba
        FROM wide""",
}


def _logistic(intercept: float, coefficients: dict[str, float], fills: dict[str, float]) -> str:
    terms = [f"({v}::DOUBLE) * coalesce({c}, {fills.get(c, 0.0)}::DOUBLE)" for c, v in coefficients.items()]
    return f"round(1 / (1 + exp(-({' + '.join([f'({intercept}::DOUBLE)', *terms])}))), 9)"


_SELECTS["score_saved_model"] = "SELECT subject_id, " + ", ".join(
    f"{_logistic(*LOGISTIC_MODELS[label])} AS {name}" for label, name in PROBABILITY_COLUMNS.items()
) + " FROM wide"

_TIMES = {"admittime", "edregtime", "first_icu_intime", "charttime"}
_NUMBERS = {"admission_age", "height_cm", "weight_kg", "valuenum"}


def _digest(output: str, relation: str, columns: list[str]) -> str:
    """Rows and digest of one output: a sum over the first 60 bits of the rows' md5."""

    def text(c: str) -> str:
        if c in _NUMBERS:
            return f"CASE WHEN isnan({c}) THEN 'NaN' ELSE round({c} * 1000000)::BIGINT::VARCHAR END"
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c in _TIMES else f"{c}::VARCHAR"

    row = " || '|' || ".join(f"coalesce({text(c)}, '\\N')" for c in sorted(columns))
    return f"""SELECT '{output}' AS output, count(*) AS rows,
          coalesce(sum(('0x' || substr(md5({row}), 1, 15))::BIGINT)::VARCHAR, '0') AS digest FROM {relation}"""


_SELECTS["published_digests"] = " UNION ALL ".join(
    [
        _digest("cohort", "wide", COHORT_COLUMNS + FEATURE_COLUMNS),
        _digest("labs", "labs", MEASURE_COLUMNS),
        _digest("vitals", "vitals", MEASURE_COLUMNS),
        _digest("targets", "outcomes", TARGET_COLUMNS),
    ]
)
_SELECTS["rejected_cells"] = " UNION ALL ".join(
    f"""SELECT 'admissions' AS relation, '{column}' AS column_name, '{value}' AS value, count(*) AS cells
        FROM admissions WHERE {key} % {share} = 0 HAVING count(*) > 0"""
    for column, value, key, share in (
        ("admittime", "unknown", "hadm_id", 50), ("has_chartevents_data", "yes", "subject_id", 7),
    )
)
_SELECTS["admission_key_audit"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS relation, count(*) AS row_count, count(*) - count({key}) AS missing,
          count(DISTINCT {key}) AS distinct_keys,
          (SELECT count(*) FROM (SELECT {key} FROM {name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1)) AS repeated_keys,
          count({key}) - count(DISTINCT {key}) AS surplus_rows FROM {name}"""
    for name, key in {
        "admissions": "hadm_id", "patients": "subject_id", "icustays": "hadm_id", "labevents": "hadm_id",
    }.items()
)


def oracle_sql() -> dict[str, str]:
    return {name: f"{_PREAMBLE}\n{select}" for name, select in _SELECTS.items()}
