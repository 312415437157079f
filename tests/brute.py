"""Row-by-row reading of the extraction rules in plain Python, for small random clinics."""

from __future__ import annotations

import math
import random
from datetime import timedelta

from anchorline import fixed_values as fv
from clinic import BASE, admission, d, event, h, patient

WINDOW = timedelta(hours=fv.WINDOW_HOURS)


def random_clinic(seed: int, subjects: int = 120) -> dict[str, list[dict]]:
    rng = random.Random(seed)
    rows: dict[str, list[dict]] = {
        name: []
        for name in (
            "admissions patients icustays chartevents inputevents_cv inputevents_mv "
            "prescriptions procedureevents_mv microbiologyevents labevents"
        ).split()
    }
    chart_items = [920, 3485, 762, 3581, 467, 223848, 223849, 60, 152, 211, 51, 676, 999]
    hadm = 1000
    for subject in range(1, subjects + 1):
        born = BASE - d(rng.choice([17, 18, 40, 50, 60, 70, 88, 89, 120]) * 365 + rng.randint(-1, 1))
        died = BASE + h(rng.randint(0, 2000)) if rng.random() < 0.4 else None
        if rng.random() < 0.95:
            rows["patients"].append(patient(subject, born if rng.random() < 0.95 else None, died))
        for _ in range(rng.randint(1, 3)):
            hadm += 1
            admit = BASE + d(rng.randint(0, 40)) if rng.random() < 0.95 else None
            rows["admissions"].append(
                admission(
                    subject,
                    hadm,
                    admit,
                    h(rng.choice([53, 54, 100, 168, 169, 400])),
                    has_chartevents_data=rng.choice([1, 1, 1, 1, 0, None]),
                    insurance=rng.choice(["Medicare", "self pay", None, "PRIVATE"]),
                )
            )
            start = admit or BASE

            def at():
                return start + h(rng.choice([-1, 0, 1, 2, 2, 24, 47, 48, 49])) if rng.random() < 0.95 else None

            owner = subject if rng.random() < 0.95 else subject + 1
            for _ in range(rng.randint(0, 2)):
                rows["icustays"].append({"hadm_id": hadm, "intime": at()})
            for _ in range(rng.randint(0, 25)):
                rows["chartevents"].append(
                    event(
                        owner,
                        hadm,
                        at(),
                        rng.choice(chart_items),
                        rng.choice([None, 5.0, 20.0, 70.5, 180.0, 250.0, 251.0, float("nan")]),
                        rng.choice([None, "Ventilator", "Other", "Mask"]),
                        rng.choice([0, 0, 0, 1, None]),
                    )
                )
            for _ in range(rng.randint(0, 3)):
                item = rng.choice([221906, 30131, 999])
                rows["inputevents_cv"].append(event(owner, hadm, at(), item))
                item = rng.choice([221749, 225150, 999])
                rows["inputevents_mv"].append(event(owner, hadm, at(), item, time="starttime"))
                rows["prescriptions"].append(
                    {
                        "subject_id": owner,
                        "hadm_id": hadm,
                        "startdate": at(),
                        "drug": rng.choice(["ZOSYN 4.5g", "Aspirin", None]),
                    }
                )
                item = rng.choice([225802, 999])
                rows["procedureevents_mv"].append(event(owner, hadm, at(), item, time="starttime"))
                rows["microbiologyevents"].append(
                    {
                        "subject_id": owner,
                        "hadm_id": hadm,
                        "charttime": at(),
                        "spec_type_desc": rng.choice(["BLOOD CULTURE (MYCO)", "URINE", None]),
                        "org_name": rng.choice(["STAPH", None]),
                    }
                )
            for _ in range(rng.randint(0, 15)):
                rows["labevents"].append(
                    event(
                        owner,
                        hadm,
                        at(),
                        rng.choice([50912, 50983, 51222, 999]),
                        rng.choice([None, 0.1, 0.05, 15.0, 25.5, 140.0, float("nan")]),
                    )
                )
    for table in rows.values():
        rng.shuffle(table)
    return rows


def _hours(delta) -> float:
    return delta.total_seconds() / 3600


def expected(rows: dict[str, list[dict]], subjects: list[int]) -> dict[str, list[tuple]]:
    patients = {p["subject_id"]: p for p in rows["patients"]}
    firsts = []
    for subject in sorted(set(subjects)):
        if subject not in patients:
            continue
        mine = [a for a in rows["admissions"] if a["subject_id"] == subject]
        mine.sort(key=lambda a: (a["admittime"] is None, a["admittime"] or BASE, a["hadm_id"]))
        if mine:
            firsts.append((mine[0], mine[1] if len(mine) > 1 else None, patients[subject]))

    cohort, targets, labs, vitals = [], [], [], []
    for adm, following, person in firsts:
        admit, left, dob, dod = adm["admittime"], adm["dischtime"], person["dob"], person["dod"]
        if admit is None or left is None or dob is None:
            continue
        age = (admit - dob).total_seconds() / fv.SECONDS_PER_YEAR
        if not 18 <= age <= 89 or _hours(left - admit) < 54 or adm["has_chartevents_data"] != 1:
            continue
        if dod is not None and _hours(dod - admit) < 54:
            continue
        back = following["admittime"] if following else None
        targets.append(
            (
                adm["subject_id"],
                adm["hadm_id"],
                int(dod is not None and dod <= left + d(30)),
                int(left - admit > d(7)),
                int(back is not None and back <= left + d(30)),
            )
        )

        def inside(table, time, both=True):
            for e in rows[table]:
                if e["hadm_id"] != adm["hadm_id"] or e[time] is None:
                    continue
                if both and e["subject_id"] != adm["subject_id"]:
                    continue
                if admit <= e[time] <= admit + WINDOW:
                    yield e

        clear = [e for e in inside("chartevents", "charttime") if e["error"] == 0]

        def first(items, scaled, factor):
            found = [e for e in clear if e["itemid"] in items and e["valuenum"] is not None]
            if not found:
                return None
            order = lambda e: (  # noqa: E731  NaN sorts last, as Spark does
                e["charttime"], e["itemid"], math.isnan(e["valuenum"]), e["valuenum"]
            )
            best = min(found, key=order)
            value = best["valuenum"] * factor if best["itemid"] in scaled else best["valuenum"]
            return None if math.isnan(value) else value

        def ventilated(e):
            text = (e["value"] or "").lower()
            return (
                e["itemid"] in fv.VENT_SETTING_ITEMS + fv.PEEP_ITEMS + fv.TIDAL_VOLUME_ITEMS
                or (e["itemid"] == 467 and "ventilator" in text)
                or (e["itemid"] == 223848 and "other" not in text)
            )

        infusions = [e["itemid"] for e in inside("inputevents_cv", "charttime")]
        infusions += [e["itemid"] for e in inside("inputevents_mv", "starttime")]
        icu = [e["intime"] for e in inside("icustays", "intime", both=False)]
        insurance = (adm["insurance"] or "").upper()
        cohort.append(
            (
                adm["subject_id"],
                adm["hadm_id"],
                insurance if insurance in fv.VOCABULARIES["insurance"] else "OTHER",
                age,
                min(icu) if icu else None,
                first(
                    fv.HEIGHT_INCH_ITEMS + fv.HEIGHT_CM_ITEMS, fv.HEIGHT_INCH_ITEMS, fv.CM_PER_INCH
                ),
                first(fv.WEIGHT_KG_ITEMS + fv.WEIGHT_LB_ITEMS, fv.WEIGHT_LB_ITEMS, fv.KG_PER_LB),
                int(any(i in fv.VASOPRESSOR_ITEMS for i in infusions)),
                int(any(i in fv.SEDATION_ITEMS for i in infusions)),
                int(
                    any(
                        word in (e["drug"] or "").lower()
                        for e in inside("prescriptions", "startdate")
                        for word in fv.ANTIBIOTIC_KEYWORDS
                    )
                ),
                int(any(ventilated(e) for e in clear)),
                int(
                    any(
                        e["itemid"] in fv.RRT_PROCEDURE_ITEMS
                        for e in inside("procedureevents_mv", "starttime")
                    )
                    or any(e["itemid"] in fv.RRT_CHART_ITEMS for e in clear)
                ),
                int(
                    any(
                        "blood culture" in (e["spec_type_desc"] or "").lower()
                        and e["org_name"] is not None
                        for e in inside("microbiologyevents", "charttime")
                    )
                ),
            )
        )
        for found, bounds, out in (
            (inside("labevents", "charttime"), fv.LAB_BOUNDS, labs),
            (clear, fv.VITAL_BOUNDS, vitals),
        ):
            limits = {item: (low, high) for item, low, high in bounds}
            for e in found:
                low, high = limits.get(e["itemid"], (1, 0))
                if e["valuenum"] is not None and low <= e["valuenum"] <= high:
                    out.append(
                        (e["subject_id"], e["hadm_id"], e["charttime"], e["itemid"], e["valuenum"])
                    )
    return {"cohort": cohort, "targets": targets, "labs": labs, "vitals": vitals}
