"""The rulesets of document types: required fields, what a field looks like where it is shown, and rules of dates."""

from __future__ import annotations

#: A ruleset by document type, as its file has it.
RULES = {
    "passport": {
        "required_fields": ["passport_number", "name", "nationality", "date_of_birth", "date_of_expiry", "mrz_lines"],
        "patterns": {
            "passport_number": r"^(?:[A-Z][0-9]{7}|[A-Z]{2}[0-9]{6,7})$",
            "nationality": r"^(?:IND|INDIAN|INDIA)$",
            "name": r"^[A-Z][A-Z ]{1,38}[A-Z]$",
            "mrz_line1": r"^P<[A-Z]{3}[A-Z<]{39}$",
            "mrz_line2": r"^[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[0-9][MFX<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9<][0-9]$",
            "file_number": r"^[A-Z]{1,2}[A-Z0-9]{10,11}$",
        },
        "date_rules": {"date_of_birth": {"must_be_past": True}, "date_of_expiry": {"must_be_after_today": True, "must_be_after_dob": True}},
    },
    "visa": {
        "required_fields": ["visa_number", "visa_type", "entry_validation", "stay_duration"],
        "patterns": {
            "visa_number": r"^(?:[A-Z0-9]{8,12}|\d{8})$",
            "visa_type": r"^(?:tourist|business|student|employment|medical|conference|transit|journalist|project|research|entry|x-misc)$",
            "entry_validation": r"^(?:single|double|multiple)$",
            "stay_duration": r"^(?:[1-9]|[1-9][0-9]{1,3})\s*(?:day|days|month|months|year|years)$",
            "port_of_issue": r"^[A-Z][A-Za-z .\-]{2,49}$",
            "eta_number": r"^[A-Z0-9]{8,12}$",
            "application_id": r"^[A-Z][0-9]{3}[A-Z][0-9A-Z]{7,9}$",
            "mrz_line1": r"^V[<A-Z][A-Z<]{3}[A-Z<]{31,39}$",
            "mrz_line2": r"^[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{6}[0-9][MFX<][0-9]{6}[0-9][A-Z0-9<]{8,16}$",
        },
        "date_rules": {"date_of_birth": {"must_be_past": True}, "date_of_expiry": {"must_be_after_today": True, "must_be_after_dob": True}},
    },
    "national_id": {
        "required_fields": ["id_number", "name", "date_of_birth"],
        "patterns": {
            "id_number": r"^[2-9][0-9]{11}$",
            "id_spaced": r"^[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}$",
            "name": r"^[A-Z][A-Za-z .]{1,99}$",
            "gender": r"^(?:M|F|Male|Female|Third Gender)$",
            "pin_code": r"^[1-9][0-9]{5}$",
            "vid": r"^[2-9][0-9]{15}$",
        },
        "date_rules": {"date_of_birth": {"must_be_past": True}},
    },
    "driving_license": {
        "required_fields": ["license_number", "name"],
        "patterns": {
            "license_number": r"^[A-Z]{2}[0-9]{2}(?:19|20)[0-9]{2}[0-9]{7}$",
            "name": r"^[A-Z][A-Za-z .'-]{1,98}$",
            "vehicle_class": r"^(?:LMV|MCWG|MCWOG|HPMV|HTV|HGV|MGV|LPV|LDRXCV|ADAPT|TR|NT)(?:[,/ ]*(?:LMV|MCWG|MCWOG|HPMV|HTV|HGV|MGV|LPV|LDRXCV|ADAPT|TR|NT))*$",
            "rto_code": r"^[A-Z]{2}[0-9]{2}$",
            "blood_group": r"^(?:A|B|AB|O)[+-]?$",
        },
        "date_rules": {"date_of_birth": {"must_be_past": True}, "date_of_expiry": {"must_be_after_today": True}},
    },
    "permit": {
        "required_fields": ["permit_number", "name", "permit_type"],
        "patterns": {
            "permit_number": r"^(?:[A-Z]{2}[0-9]{2}(?:19|20)[0-9]{2}[A-Z0-9]{5,8}|[0-9]{8,22}|[A-Z0-9\-_/]{5,25})$",
            "name": r"^[A-Z][A-Za-z .]{1,99}$",
            "permit_type": r"^(?:single|multiple|temporary|inner-line|ilp|eilp|business|labor|labour|tourist|national|state|goods|taxi|maxi-cab|contract-carriage|stage-carriage|educational-institution|work|transit|resident|special-entry).*$",
            "rto_code": r"^[A-Z]{2}[0-9]{2}$",
            "vehicle_no": r"^(?:[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}|[A-Z0-9\-\s]{4,15})?$",
        },
        "date_rules": {"date_of_expiry": {"must_be_after_today": False}},
    },
}
