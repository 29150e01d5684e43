"""A tiny synthetic clinic in the raw table layout."""

import gzip
import os

from tidemark.sources.tables import RAW_COLUMNS

ROWS = {
    "ADMISSIONS": [
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ADMITTIME": "2020-01-01 00:00:00", "HOSPITAL_EXPIRE_FLAG": "0"},
        {"SUBJECT_ID": "1", "HADM_ID": "101", "ADMITTIME": "2020-03-01 00:00:00", "DEATHTIME": "2020-03-09 00:00:00"},
        {"SUBJECT_ID": "2", "HADM_ID": "200", "ADMITTIME": "2020-01-01 00:00:00", "HOSPITAL_EXPIRE_FLAG": "x"},
        {"SUBJECT_ID": "3", "HADM_ID": "300", "ADMITTIME": "zzz", "HOSPITAL_EXPIRE_FLAG": "1"},
    ],
    "PATIENTS": [
        {"SUBJECT_ID": "1", "GENDER": "m", "DOB": "1960-01-01 00:00:00"},
        {"SUBJECT_ID": "2", "GENDER": "F", "DOB": "1720-01-01 00:00:00"},
    ],
    "ICUSTAYS": [
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ICUSTAY_ID": "1", "INTIME": "2020-01-01 06:00:00", "OUTTIME": "2020-01-04 06:00:00", "LOS": "3.0"},
        {"SUBJECT_ID": "1", "HADM_ID": "101", "ICUSTAY_ID": "2", "INTIME": "2020-03-01 00:00:00", "OUTTIME": "2020-03-01 12:00:00", "LOS": "0.5"},
        {"SUBJECT_ID": "1", "HADM_ID": "101", "ICUSTAY_ID": "3", "INTIME": "2020-03-05 00:00:00", "OUTTIME": "2020-03-06 00:00:00", "LOS": "1.0"},
        {"SUBJECT_ID": "2", "HADM_ID": "200", "ICUSTAY_ID": "4", "INTIME": "2020-01-02 00:00:00", "OUTTIME": "2020-01-04 00:00:00", "LOS": ">2"},
    ],
    "CHARTEVENTS": [
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ITEMID": "211", "CHARTTIME": t, "VALUENUM": v}
        for t, v in [
            ("2020-01-01 05:00:00", "60"), ("2020-01-01 06:00:00", "70"), ("2020-01-01 11:59:59", "80"),
            ("2020-01-01 12:00:00", "90"), ("2020-01-03 06:00:00", "100"), ("2020-01-04 06:00:00", "110"),
            ("2020-01-04 06:00:01", "120"), ("", "130"), ("2020-01-02 00:00:00", "12,5"), ("2020-01-02 00:00:00", "999"),
        ]
    ] + [
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ITEMID": "678", "CHARTTIME": "2020-01-01 07:00:00", "VALUENUM": "98.6"},
        {"SUBJECT_ID": "1", "HADM_ID": "", "ITEMID": "211", "CHARTTIME": "2020-01-01 07:00:00", "VALUENUM": "50"},
        {"SUBJECT_ID": "1", "HADM_ID": "101", "ITEMID": "646", "CHARTTIME": "2020-03-02 00:00:00", "VALUENUM": "97"},
        {"SUBJECT_ID": "2", "HADM_ID": "200", "ITEMID": "x", "CHARTTIME": "2020-01-02 01:00:00", "VALUENUM": "97"},
    ],
    "LABEVENTS": [
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ITEMID": "50", "CHARTTIME": "2020-01-01 06:00:00", "VALUENUM": "1", "FLAG": "abnormal"},
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ITEMID": "51", "CHARTTIME": "2020-01-03 06:00:00", "VALUENUM": "3", "FLAG": "NORMAL"},
        {"SUBJECT_ID": "1", "HADM_ID": "100", "ITEMID": "52", "CHARTTIME": "2020-01-01 05:59:59", "VALUENUM": "5", "FLAG": ""},
        {"SUBJECT_ID": "2", "HADM_ID": "200", "ITEMID": "52", "CHARTTIME": "2020-01-02 05:00:00", "VALUENUM": "", "FLAG": "delta"},
    ],
}


def write_clinic(folder):
    for name, data in ROWS.items():
        columns = RAW_COLUMNS[name]
        with gzip.open(os.path.join(folder, f"{name}.csv.gz"), "wt") as f:
            f.write(",".join(columns) + "\n")
            for row in data:
                f.write(",".join(f'"{row[c]}"' if row.get(c) else "" for c in columns) + "\n")
