"""Table and column definitions shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# Public CMS column names and the names used after cleaning.
PRESCRIBER_COLUMNS = {
    "PRSCRBR_NPI": "prescriber_id",
    "Prscrbr_First_Name": "first_name",
    "Prscrbr_Last_Org_Name": "last_name",
    "Prscrbr_Crdntls": "credentials",
    "Prscrbr_Type": "provider_type",
    "Prscrbr_State_Abrvtn": "state",
    "Prscrbr_City": "city",
    "Prscrbr_zip5": "zip",
    "Tot_Clms": "total_claims",
    "Tot_Drug_Cst": "total_drug_cost",
    "Tot_Benes": "total_beneficiaries",
    "Opioid_Tot_Clms": "opioid_claims",
    "Opioid_Tot_Drug_Cst": "opioid_cost",
    "Opioid_Tot_Benes": "opioid_beneficiaries",
    "Opioid_Prscrbr_Rate": "opioid_rate",
    "Antbtc_Tot_Clms": "antibiotic_claims",
    "Antbtc_Tot_Drug_Cst": "antibiotic_cost",
    "Bene_Avg_Age": "avg_patient_age",
    "Bene_Feml_Cnt": "female_patients",
    "Bene_Male_Cnt": "male_patients",
    "Bene_Avg_Risk_Scre": "avg_risk_score",
}

PAYMENT_COLUMNS = {
    "Covered_Recipient_NPI": "NPI",
    "Covered_Recipient_First_Name": "First_Name",
    "Covered_Recipient_Last_Name": "Last_Name",
    "Covered_Recipient_Specialty_1": "Specialty",
    "Recipient_City": "City",
    "Recipient_State": "State",
    "Recipient_Zip_Code": "Zip",
    "Total_Amount_of_Payment_USDollars": "Payment_Amount",
    "Date_of_Payment": "Payment_Date",
    "Form_of_Payment_or_Transfer_of_Value": "Payment_Form",
    "Nature_of_Payment_or_Transfer_of_Value": "Payment_Nature",
    "Submitting_Applicable_Manufacturer_or_Applicable_GPO_Name": "Manufacturer",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1": "Drug_or_Device",
    "Product_Category_or_Therapeutic_Area_1": "Therapeutic_Area",
    "Physician_Ownership_Indicator": "Ownership",
    "Third_Party_Payment_Recipient_Indicator": "Third_Party_Recipient",
    "Charity_Indicator": "Charity",
    "Dispute_Status_for_Publication": "Dispute_Status",
}

# Cleaned names of the number columns, of the payment summary and of a record's identity.
PRESCRIBER_NUMERIC = [
    "total_claims",
    "total_drug_cost",
    "total_beneficiaries",
    "opioid_claims",
    "opioid_cost",
    "opioid_beneficiaries",
    "opioid_rate",
    "antibiotic_claims",
    "antibiotic_cost",
    "avg_patient_age",
    "female_patients",
    "male_patients",
    "avg_risk_score",
]

PAYMENT_SUMMARY_COLUMNS = [
    "total_payment_amount",
    "num_payments",
    "avg_payment_amount",
    "max_payment_amount",
]

# The columns the risk rules read, and the model features that avoid them.
RULE_INPUTS = [
    "payment_to_drug_cost_ratio",
    "opioid_claims",
    "high_payment_flag",
    "high_opioid_flag",
    "peer_deviation_score",
    "elderly_focus_flag",
]

MODEL_FEATURES = [
    "total_claims",
    "total_drug_cost",
    "opioid_cost",
    "antibiotic_claims",
    "avg_risk_score",
    "payment_variability",
    "adjusted_risk_payment",
]

# Accepted (lowest, highest) value of each scoring input.
SCORING_RANGES = {
    "total_claims": (0.0, 200_000.0),
    "total_drug_cost": (0.0, 20_000_000.0),
    "opioid_claims": (0.0, 50_000.0),
    "opioid_cost": (0.0, 10_000_000.0),
    "antibiotic_claims": (0.0, 50_000.0),
    "payment_to_drug_cost_ratio": (0.0, 20.0),
    "peer_deviation_score": (0.0, 20.0),
    "avg_risk_score": (0.0, 5.0),
    "payment_variability": (0.0, 50.0),
    "adjusted_risk_payment": (0.0, 50_000_000.0),
    "high_payment_flag": (0.0, 1.0),
    "high_opioid_flag": (0.0, 1.0),
    "elderly_focus_flag": (0.0, 1.0),
}

# The text columns of a scoring record.
SCORING_ID_COLUMNS = ["prescriber_id", "first_name", "last_name", "provider_type", "state"]


def _fields(names: list[str], doubles: set[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, T.DoubleType() if n in doubles else T.StringType()) for n in names]
    )


def text_schema(names: list[str]) -> T.StructType:
    """Every column as text, for files whose values are cleaned after the scan."""
    return _fields(names, set())


# Typed scans. ZIP codes and identifiers stay text: "02134" must keep its zero.
RAW_PRESCRIBERS = _fields(
    list(PRESCRIBER_COLUMNS),
    {raw for raw, clean in PRESCRIBER_COLUMNS.items() if clean in PRESCRIBER_NUMERIC},
)
# Payment amounts too: a currency sign or a separator would turn a typed amount into null.
RAW_PAYMENTS = text_schema(list(PAYMENT_COLUMNS))
SCORING_RECORD = _fields(SCORING_ID_COLUMNS + list(SCORING_RANGES), set(SCORING_RANGES))
