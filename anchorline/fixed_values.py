"""Fixed values of the clinical extraction.

Everything in this module is a FIXED VALUE: item codes, keywords, category
vocabularies, conversion factors and plausible-value bounds have to be exactly
these for results to be right.  They are data, kept together and in their
natural order; no logic lives here.
"""

# --- fixed values: time and threshold constants -----------------------------
WINDOW_HOURS = 48
GAP_HOURS = 6
MIN_LOS_HOURS = 54
MIN_AGE = 18
MAX_AGE = 89
PROLONGED_LOS_DAYS = 7
READMISSION_DAYS = 30
MORTALITY_DAYS = 30
SECONDS_PER_HOUR = 3600
SECONDS_PER_YEAR = 31536000  # a 365-day year

# --- fixed values: chart item codes -----------------------------------------
HEIGHT_INCH_ITEMS = [920, 1394, 4187, 3486, 226707]
HEIGHT_CM_ITEMS = [3485, 4188]
CM_PER_INCH = 2.54

WEIGHT_KG_ITEMS = [762, 763, 3723, 3580, 226512]
WEIGHT_LB_ITEMS = [3581, 226531]
KG_PER_LB = 0.45359237

VENT_SETTING_ITEMS = [223849]
PEEP_ITEMS = [60, 437, 505, 506, 686, 220339, 224700]
TIDAL_VOLUME_ITEMS = [639, 654, 681, 682, 683, 684, 224684, 224685, 224686]
OXYGEN_DEVICE_VENTILATOR_ITEM = 467  # counts when the text names a ventilator
OXYGEN_DEVICE_NOT_OTHER_ITEM = 223848  # counts unless the text says "other"
VENTILATOR_TEXT = "ventilator"
OTHER_DEVICE_TEXT = "other"

RRT_CHART_ITEMS = [152]

# --- fixed values: input and procedure item codes ---------------------------
VASOPRESSOR_ITEMS = [
    221906, 30047, 30120, 221289, 30044, 30119, 30309, 221749, 30127,
    30128, 221662, 30043, 30307, 222315, 30051, 30042, 30306,
]
SEDATION_ITEMS = [
    222168, 30131, 221668, 30124, 221744, 225972,
    225942, 30150, 30308, 30118, 30149, 225150,
]
RRT_PROCEDURE_ITEMS = [225802, 225803, 225441]

# --- fixed values: text patterns --------------------------------------------
ANTIBIOTIC_KEYWORDS = [
    "vancomycin", "zosyn", "piperacillin", "tazobactam", "cefepime",
    "meropenem", "levofloxacin", "azithromycin", "ceftriaxone", "metronidazole",
]
BLOOD_CULTURE_TEXT = "blood culture"

# --- fixed values: category vocabularies ------------------------------------
OTHER_CATEGORY = "OTHER"
VOCABULARIES = {
    "admission_type": ["EMERGENCY", "URGENT", "ELECTIVE"],
    "admission_location": [
        "EMERGENCY ROOM ADMIT",
        "TRANSFER FROM HOSP/EXTRAM",
        "TRANSFER FROM OTHER HEALT",
        "CLINIC REFERRAL/PREMATURE",
        "** INFO NOT AVAILABLE **",
        "TRANSFER FROM SKILLED NUR",
        "TRSF WITHIN THIS FACILITY",
        "HMO REFERRAL/SICK",
        "PHYS REFERRAL/NORMAL DELI",
    ],
    "insurance": ["MEDICARE", "PRIVATE", "MEDICAID", "GOVERNMENT", "SELF_PAY"],
    "language": [
        "ENGL", "SPAN", "RUSS", "CANT", "PORT", "MAND", "HAIT",
        "FREN", "GREE", "ITAL", "CAPE", "VIET", "ARAB",
    ],
    "religion": [
        "CATHOLIC", "NOT_SPECIFIED", "UNOBTAINABLE", "PROTESTANT_QUAKER",
        "JEWISH", "OTHER", "CHRISTIAN_SCIENTIST", "BUDDHIST", "MUSLIM",
        "JEHOVAHS_WITNESS", "GREEK_ORTHODOX", "HINDU",
        "UNITARIAN_UNIVERSALIST", "SEVENTH_DAY_ADVENTIST",
        "ROMANIAN_EAST_ORTH", "BAPTIST", "EPISCOPALIAN", "LUTHERAN",
        "METHODIST", "HEBREW",
    ],
    "marital_status": [
        "MARRIED", "SINGLE", "WIDOWED", "DIVORCED", "SEPARATED",
        "UNKNOWN_NOT_SPECIFIED", "LIVING_WITH_PARTNER",
    ],
    "ethnicity": [
        "WHITE", "BLACK_AFRICAN_AMERICAN", "UNKNOWN_NOT_SPECIFIED",
        "HISPANIC_OR_LATINO", "ASIAN", "UNABLE_TO_OBTAIN",
        "PATIENT_DECLINED_TO_ANSWER", "OTHER", "ASIAN_CHINESE",
        "HISPANIC_LATINO_PUERTO_RICAN", "BLACK_CAPE_VERDEAN", "WHITE_RUSSIAN",
        "MULTI_RACE_ETHNICITY", "BLACK_HAITIAN", "ASIAN_VIETNAMESE",
        "ASIAN_CAMBODIAN", "WHITE_EASTERN_EUROPEAN", "ASIAN_FILIPINO",
        "HISPANIC_LATINO_DOMINICAN", "WHITE_OTHER_EUROPEAN", "PORTUGUESE",
        "BLACK_AFRICAN", "MIDDLE_EASTERN", "ASIAN_INDIAN",
        "HISPANIC_LATINO_GUATEMALAN", "ASIAN_ASIAN_INDIAN",
        "HISPANIC_LATINO_CUBAN", "AMERICAN_INDIAN_ALASKA_NATIVE",
        "HISPANIC_LATINO_SALVADORAN",
        "NATIVE_HAWAIIAN_OR_OTHER_PACIFIC_ISLANDER", "ASIAN_KOREAN",
        "CARIBBEAN_ISLAND", "SOUTH_AMERICAN",
    ],
}

# --- fixed values: plausible bounds, (itemid, min, max) ---------------------
LAB_BOUNDS = [
    (50868, 1.0, 40.0),
    (50862, 0.1, 10.0),
    (50882, 1.0, 100.0),
    (50885, 0.0, 20.0),
    (50912, 0.1, 15.0),
    (50806, 80.0, 130.0),
    (50902, 80.0, 130.0),
    (50931, 15.0, 2000.0),
    (50809, 15.0, 2000.0),
    (51221, 10.0, 80.0),
    (50810, 10.0, 80.0),
    (51222, 2.0, 25.0),
    (50811, 2.0, 25.0),
    (50813, 0.2, 15.0),
    (50960, 0.5, 4.0),
    (50970, 0.1, 20.0),
    (51265, 0.1, 1000.0),
    (50971, 1.0, 10.0),
    (50822, 1.0, 10.0),
    (51275, 5.0, 200.0),
    (51237, 0.5, 10.0),
    (51274, 5.0, 50.0),
    (50983, 100.0, 200.0),
    (50824, 100.0, 200.0),
    (51006, 2.0, 200.0),
    (51301, 0.2, 150.0),
    (51300, 0.2, 150.0),
]
VITAL_BOUNDS = [
    (211, 10.0, 300.0),
    (220045, 10.0, 300.0),
    (51, 20.0, 250.0),
    (442, 20.0, 250.0),
    (455, 20.0, 250.0),
    (6701, 20.0, 250.0),
    (220179, 20.0, 250.0),
    (220050, 20.0, 250.0),
    (8368, 20.0, 240.0),
    (8440, 20.0, 240.0),
    (8441, 20.0, 240.0),
    (8555, 20.0, 240.0),
    (220180, 20.0, 240.0),
    (220051, 20.0, 240.0),
    (456, 20.0, 245.0),
    (52, 20.0, 245.0),
    (6702, 20.0, 245.0),
    (443, 20.0, 245.0),
    (220052, 20.0, 245.0),
    (220181, 20.0, 245.0),
    (225312, 20.0, 245.0),
    (618, 5.0, 100.0),
    (615, 5.0, 100.0),
    (220210, 5.0, 100.0),
    (224690, 5.0, 100.0),
    (646, 5.0, 100.0),
    (220277, 5.0, 100.0),
    (807, 15.0, 2000.0),
    (811, 15.0, 2000.0),
    (1529, 15.0, 2000.0),
    (3745, 15.0, 2000.0),
    (3744, 15.0, 2000.0),
    (225664, 15.0, 2000.0),
    (220621, 15.0, 2000.0),
    (226537, 15.0, 2000.0),
    (223762, 20.0, 45.0),
    (676, 20.0, 45.0),
    (223761, 68.0, 113.0),
    (678, 68.0, 113.0),
]
