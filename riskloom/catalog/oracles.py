"""The queries restated in SQL over the given tables, as an independent check of their results.

Random splits and samples and fitted models have no SQL form.
"""

from __future__ import annotations

from riskloom.functions.labels import TIERS
from riskloom.schemas import (
    MODEL_FEATURES,
    PAYMENT_COLUMNS,
    PRESCRIBER_COLUMNS,
    PRESCRIBER_NUMERIC,
    SCORING_ID_COLUMNS,
    SCORING_RANGES,
)

# --- the two raw tables --------------------------------------------------------------

DOLLARS = "cast(sum(cast({0} as decimal(18,2))) as double)"

CLAIMS = """claims as (
  select o.o_custkey as ck, count(*) as items, count(distinct l.l_orderkey) as orders,
    cast(sum(cast(l.l_extendedprice as decimal(18,2))) as double) as cost,
    count(case when l.l_returnflag = 'R' then 1 end) as opioid_items,
    cast(sum(case when l.l_returnflag = 'R' then cast(l.l_extendedprice as decimal(18,2)) end) as double) as opioid_cost,
    count(distinct case when l.l_returnflag = 'R' then l.l_orderkey end) as opioid_orders,
    count(case when l.l_returnflag = 'A' then 1 end) as antibiotic_items,
    cast(sum(case when l.l_returnflag = 'A' then cast(l.l_extendedprice as decimal(18,2)) end) as double) as antibiotic_cost,
    sum(cast(l.l_quantity as bigint)) as quantity,
    sum(cast(round(l.l_discount * 100) as bigint)) as discount,
    count(case when l.l_linestatus = 'F' then 1 end) as female,
    count(case when l.l_linestatus = 'O' then 1 end) as male
  from orders o join lineitem l on l.l_orderkey = o.o_orderkey
  group by o.o_custkey)"""

ZERO = "cast(0 as double)"

RAW = f"""raw as (
  select cast(c.c_custkey as varchar) as prescriber_id,
    split_part(c.c_name, '#', 1) as first_name, split_part(c.c_name, '#', 2) as last_name,
    case c.c_custkey % 3 when 0 then 'MD' when 1 then 'DO' end as credentials,
    c.c_mktsegment as provider_type, n.n_name as state,
    'City ' || cast(c.c_custkey % 97 as varchar) as city,
    lpad(cast((c.c_custkey * 613 + 7) % 100000 as varchar), 5, '0') as zip,
    cast(coalesce(items, 0) as double) as total_claims,
    coalesce(cost, {ZERO}) as total_drug_cost,
    cast(coalesce(orders, 0) as double) as total_beneficiaries,
    cast(coalesce(opioid_items, 0) as double) as opioid_claims,
    coalesce(opioid_cost, {ZERO}) as opioid_cost,
    cast(coalesce(opioid_orders, 0) as double) as opioid_beneficiaries,
    cast(100 as double) * opioid_items / items as opioid_rate,
    cast(coalesce(antibiotic_items, 0) as double) as antibiotic_claims,
    coalesce(antibiotic_cost, {ZERO}) as antibiotic_cost,
    cast(items * 45 + quantity as double) / items as avg_patient_age,
    cast(coalesce(female, 0) as double) as female_patients,
    cast(coalesce(male, 0) as double) as male_patients,
    cast(discount as double) / (items * 5) as avg_risk_score
  from customer c join nation n on n.n_nationkey = c.c_nationkey left join claims on ck = c.c_custkey)"""

_ALL = list(PRESCRIBER_COLUMNS.values())
_TEXT = [c for c in _ALL if c not in PRESCRIBER_NUMERIC and c != "prescriber_id"]

CLEAN = (
    "prescribers as (select cast(prescriber_id as bigint) as prescriber_id, "
    + ", ".join(f"coalesce({c}, 'NA') as {c}" for c in _TEXT)
    + ", "
    + ", ".join(f"coalesce({c}, {ZERO}) as {c}" for c in PRESCRIBER_NUMERIC)
    + " from raw)"
)


def _untidy(column: str, shift: int) -> str:
    text = f"cast(cast(floor({column}) as bigint) as varchar)"
    return f"""case (cast(prescriber_id as bigint) + {shift}) % 8
      when 0 then '$' || {text} when 1 then {text} || 'E2' when 3 then 'None' when 4 then '-' || {text}
      when 5 then {text} || '.5' when 6 then {text} || '.5.1' when 7 then {text} end as {column}"""


UNTIDY = (
    "untidy as (select prescriber_id, "
    + ", ".join(_TEXT)
    + ", "
    + ", ".join(_untidy(c, i) for i, c in enumerate(PRESCRIBER_NUMERIC))
    + " from raw)"
)

VALUE = "cast(value as varchar)"
AMOUNT_TEXT = f"""case event_id % 8 when 0 then '$' || {VALUE} when 1 then 'USD ' || {VALUE} when 3 then 'None'
    when 4 then 'n/a' when 5 then '-' || {VALUE} when 6 then '1,' || {VALUE} when 7 then {VALUE} end"""
DIGITS = "lpad(cast((user_id * 613 + 7) % 100000 as varchar), 5, '0')"
ZIP_TEXT = f"case event_id % 4 when 0 then {DIGITS} when 1 then {DIGITS} || '-1234' when 2 then 'K1A 0B1' end"
KEY_TEXT = "case when event_id % 16 = 0 then 'NA' when event_id % 16 <> 1 then cast(user_id as varchar) end"


def _payments(name: str, npi: str, zip_code: str, amount: str) -> str:
    return f"""{name} as (
  select {npi} as "NPI", 'User' as "First_Name", cast(user_id as varchar) as "Last_Name",
    event_type as "Specialty", 'City ' || cast(user_id % 97 as varchar) as "City",
    'NATION_' || cast(user_id % 25 as varchar) as "State", {zip_code} as "Zip", {amount} as "Payment_Amount",
    cast(cast(ts as date) as varchar) as "Payment_Date",
    case event_id % 3 when 0 then 'Cash' when 1 then 'In-kind' else 'Stock' end as "Payment_Form",
    event_type as "Payment_Nature", 'Maker ' || cast(event_id % 40 as varchar) as "Manufacturer",
    case when event_id % 5 <> 0 then 'Drug ' || cast(event_id % 200 as varchar) end as "Drug_or_Device",
    'Area ' || cast(event_id % 12 as varchar) as "Therapeutic_Area",
    case when event_id % 20 = 0 then 'Yes' else 'No' end as "Ownership",
    case when event_id % 11 = 0 then 'Entity' else 'No Third Party Payment' end as "Third_Party_Recipient",
    case when event_id % 30 = 0 then 'Yes' else 'No' end as "Charity", 'No' as "Dispute_Status"
  from events)"""


USER = "cast(user_id as varchar)"


def _zip5(text: str) -> str:
    return rf"regexp_extract({text}, '^(\d{{5}})', 1)"


def _currency(text: str) -> str:
    return rf"coalesce(try_cast(nullif(regexp_extract({text}, '[\d\.]+', 0), '') as double), {ZERO})"


RAW_PAYMENTS = _payments("raw_payments", USER, ZIP_TEXT, "value")
PAYMENTS = _payments("payments", USER, _zip5(ZIP_TEXT), "value")
UNTIDY_PAYMENTS = _payments("untidy_payments", KEY_TEXT, ZIP_TEXT, AMOUNT_TEXT)

SUMMARY = f"""summary as (
  select "NPI", {DOLLARS.format('"Payment_Amount"')} as total_payment_amount,
    count("Payment_Amount") as num_payments,
    {DOLLARS.format('"Payment_Amount"')} / count("Payment_Amount") as avg_payment_amount,
    max("Payment_Amount") as max_payment_amount
  from payments group by "NPI")"""

LEVEL = f"""level as (
  select p.*, coalesce(total_payment_amount, {ZERO}) as total_payment_amount,
    coalesce(num_payments, 0) as num_payments, coalesce(avg_payment_amount, {ZERO}) as avg_payment_amount,
    coalesce(max_payment_amount, {ZERO}) as max_payment_amount
  from prescribers p left join summary s on cast(s."NPI" as bigint) = p.prescriber_id)"""


def _ratio(a: str, b: str) -> str:
    return f"case when {b} > 0 then {a} / {b} else {ZERO} end"


ENRICHED = f"""ratios as (
  select *, {_ratio("total_payment_amount", "total_claims")} as payment_per_claim,
    {_ratio("total_payment_amount", "total_drug_cost")} as payment_to_drug_cost_ratio,
    {_ratio("opioid_claims", "total_claims")} as opioid_claim_ratio,
    {_ratio("antibiotic_claims", "total_claims")} as antibiotic_claim_ratio,
    {_ratio("max_payment_amount", "avg_payment_amount")} as payment_variability,
    {_ratio("female_patients", "male_patients")} as female_to_male_ratio,
    total_payment_amount * avg_risk_score as adjusted_risk_payment
  from level), peers as (
  select provider_type, avg(avg_payment_amount) as peer_avg_payment from level group by provider_type), enriched as (
  select r.*, case when opioid_claim_ratio > 0.5 then 1 else 0 end as high_opioid_flag,
    case when avg_payment_amount > 54 then 1 else 0 end as high_payment_flag,
    case when avg_patient_age > 70 then 1 else 0 end as elderly_focus_flag,
    round(p.peer_avg_payment, 6) as peer_avg_payment,
    round({_ratio("avg_payment_amount", "p.peer_avg_payment")}, 4) as peer_deviation_score
  from ratios r left join peers p on p.provider_type = r.provider_type)"""

# Rules restated as name, detail, condition, points.
RULES = [
    ("High payment vs drug cost", "Industry payments exceed total drug cost (ratio > 0.003).",
     "payment_to_drug_cost_ratio > cast(0.003 as double)", 2),
    ("Heavy opioid prescribing", "Opioid claim count is above 25.", "opioid_claims > 25", 2),
    ("High payment flag", "Average payment size is flagged as unusually high.", "high_payment_flag = 1", 2),
    ("High opioid flag", "More than half of claims are opioid-related.", "high_opioid_flag = 1", 2),
    ("Peer payment outlier", "Payment level is far above peers in the same provider type.",
     "peer_deviation_score > 5", 2),
    ("Elderly-focused practice", "Average patient age is above 70.", "elderly_focus_flag = 1", 1),
]

SCORED = f"""scored as (
  select *, case {" ".join(f"when {cond} then {points}" for _, _, cond, points in RULES)} else 0 end as fraud_risk_score,
    case when {" or ".join(cond for _, _, cond, points in RULES if points == 2)} then 'High'
      when elderly_focus_flag = 1 then 'Medium' else 'Low' end as fraud_risk_category
  from enriched)"""

FIRED = "fired as (" + " union all ".join(
    f"select prescriber_id, '{name}' as rule_name, '{detail}' as rule_detail from scored where {cond}"
    for name, detail, cond, _ in RULES
) + ")"

MERGED = """merged as (
  select q.*, p.* exclude (first_name, last_name, city, state, zip)
  from payments q left join prescribers p on p.prescriber_id = cast(q."NPI" as bigint))"""

SURROGATE = """surrogate as (
  select prescriber_id, provider_type, state, total_claims,
    case when opioid_claims > 25 then 2 when avg_patient_age > 70 then 1 else 0 end as fraud_label,
    case when total_claims > 60 then 2 when avg_patient_age > 71 then 1 else 0 end as prediction
  from prescribers)"""

# Parts each named table is built from, in order.
_PEOPLE = [CLAIMS, RAW, CLEAN]
_LEVEL = [*_PEOPLE, PAYMENTS, SUMMARY, LEVEL]
_SCORED = [*_LEVEL, ENRICHED, SCORED]
_MERGED = [*_PEOPLE, PAYMENTS, MERGED]
_SURROGATE = [*_PEOPLE, SURROGATE]


def _with(parts: list[str], select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


def _quoted(columns) -> str:
    return ", ".join(f'"{c}"' for c in columns)


# --- expressions -----------------------------------------------------------------------


def _guarded(column: str) -> str:
    return (
        f"case when {column} is null or {column} = 'None' then {ZERO} "
        f"when regexp_matches({column}, '^[0-9.]+$') then coalesce(try_cast({column} as double), {ZERO}) "
        f"else {ZERO} end as {column}"
    )


def _bucket(value: str, modulo: int = 10000) -> str:
    return f"(cast('0x' || substr(sha256(cast({value} as varchar)), 1, 8) as bigint) % {modulo})"


def _range_error(column: str, low: float, high: float, source: str) -> str:
    text = f"trim(coalesce({source}, ''))"
    number = f"(case when {text} = '' then {ZERO} else try_cast({text} as double) end)"
    return f"""case when {number} is null then '{column}: enter a valid number.'
      when {number} < {low} or {number} > {high} then '{column}: must be between {low:,.0f} and {high:,.0f}.' end"""


_STAND_INS = {
    "payment_to_drug_cost_ratio": "female_patients",
    "peer_deviation_score": "male_patients",
    "payment_variability": "opioid_beneficiaries",
    "adjusted_risk_payment": "antibiotic_cost",
    "high_payment_flag": "opioid_rate",
    "high_opioid_flag": "avg_patient_age",
    "elderly_focus_flag": "total_beneficiaries",
}
_RANGE_ERRORS = "concat_ws('|', " + ", ".join(
    _range_error(c, low, high, _STAND_INS.get(c, c)) for c, (low, high) in SCORING_RANGES.items()
) + ")"

# Columns of the merged table with the types Spark names them by.
_MERGED_TYPES = {c: "double" if c == "Payment_Amount" else "string" for c in PAYMENT_COLUMNS.values()} | {
    c: "double" if c in PRESCRIBER_NUMERIC else "bigint" if c == "prescriber_id" else "string"
    for c in _ALL
    if c not in ("first_name", "last_name", "city", "state", "zip")
}
_MERGED_NUMERIC = [c for c, kind in _MERGED_TYPES.items() if kind != "string"]


def _per_column(columns, select) -> str:
    return " union all ".join(select(c) for c in columns)


def _stats(c: str) -> str:
    return (
        f'round(avg(cast("{c}" as double)), 4) as mean, round(stddev_samp(cast("{c}" as double)), 4) as stddev, '
        f'cast(min("{c}") as double) as min, cast(max("{c}") as double) as max'
    )


_NO_STATS = ", ".join(f"cast(null as double) as {n}" for n in ("mean", "stddev", "min", "max"))


def _distinct(c: str) -> str:
    return f'count(distinct "{c}") + max(case when "{c}" is null then 1 else 0 end)'


def _profile(c: str) -> str:
    statistics = _stats(c) if c in _MERGED_NUMERIC else _NO_STATS
    return (
        f"select '{c}' as column_name, '{_MERGED_TYPES[c]}' as data_type, "
        f'count(case when "{c}" is null then 1 end) as n_missing, {statistics}, '
        f"cast({_distinct(c)} as bigint) as n_distinct from merged"
    )


def _correlations() -> str:
    pairs = [(a, b) for a in _MERGED_NUMERIC for b in _MERGED_NUMERIC]
    return _per_column(
        pairs,
        lambda p: f"select '{p[0]}' as column_a, '{p[1]}' as column_b, "
        f'round(corr("{p[0]}", "{p[1]}"), 6) as correlation from merged',
    )


def _top(column: str, source: str) -> str:
    return (
        f'select "{column}" as value, count(*) as n_rows from {source} group by 1 '
        "order by n_rows desc, value asc nulls last limit 10"
    )


# --- metrics -----------------------------------------------------------------------------

_CLASS_COUNTS = """per_class as (
  select k as label, count(case when fraud_label = k and prediction = k then 1 end) as tp,
    count(case when fraud_label <> k and prediction = k then 1 end) as fp,
    count(case when fraud_label = k and prediction <> k then 1 end) as fn,
    count(case when fraud_label = k then 1 end) as support
  from surrogate cross join (values (0), (1), (2)) v(k) group by k), shares as (
  select *, case when tp + fp > 0 then cast(tp as double) / (tp + fp) else cast(0 as double) end as p,
    case when tp + fn > 0 then cast(tp as double) / (tp + fn) else cast(0 as double) end as r
  from per_class), metrics as (
  select label, tp, fp, fn, support, p as "precision", r as recall,
    case when p + r > 0 then 2 * p * r / (p + r) else cast(0 as double) end as f1 from shares)"""
_METRICS = [*_SURROGATE, _CLASS_COUNTS]
_ACCURACY = "cast(sum(tp) as double) / sum(support)"
_N = "cast(sum(support) as bigint)"


def _mean_of(column: str) -> str:
    parts = [f"max(case when label = {k} then {column} end)" for k in range(3)]
    return f"({' + '.join(parts)}) / 3"


def _weighted(column: str) -> str:
    parts = [f"max(case when label = {k} then {column} * support end)" for k in range(3)]
    return f"({' + '.join(parts)}) / sum(support)"


_REPORT = (
    "select case label when 0 then 'Low' when 1 then 'Medium' else 'High' end as class_name, "
    '"precision", recall, f1, support from metrics union all '
    f"select 'accuracy', null, null, {_ACCURACY}, {_N} from metrics union all "
    + " union all ".join(
        f"select '{name}', {f('\"precision\"')}, {f('recall')}, {f('f1')}, {_N} from metrics"
        for name, f in (("macro avg", _mean_of), ("weighted avg", _weighted))
    )
)

_PLAN = """counts as (select fraud_label, count(*) as n_rows from surrogate group by fraud_label), plan as (
  select fraud_label, n_rows,
    cast((select floor(cast(sum(n_rows) as double) / count(*)) from counts) as bigint) as target,
    least(floor((select cast(sum(n_rows) as double) / count(*) from counts)) / n_rows, cast(10 as double)) as fraction
  from counts)"""

_DRAWN = f"{_bucket('s.prescriber_id', 2**32)} / cast({2**32} as double)"
_RESAMPLED = f"""
  select s.prescriber_id, s.fraud_label, g.copy from (
    select s.prescriber_id, s.fraud_label, cast(floor(fraction) as bigint)
        + case when {_DRAWN} < fraction - floor(fraction) then 1 else 0 end as copies
    from surrogate s join plan p on p.fraud_label = s.fraud_label) s
  join (select cast(unnest(range(1, 12)) as bigint) as copy) g on g.copy <= s.copies"""

_SALTED = "concat('sample:', cast(prescriber_id as varchar))"


def _scaled(c: str) -> str:
    return (
        f"round(case when {c}_sd > 0 then ({c} - {c}_mean) / {c}_sd else {c} - {c}_mean end, 6) as {c}"
    )


_TIER_CODE = "case fraud_risk_category when 'Low' then 0 when 'Medium' then 1 when 'High' then 2 end"
_HOLDOUT = f"{_bucket('prescriber_id')} / cast(10000 as double) >= cast(1.0 as double) - cast(0.2 as double)"
_STANDARDIZED = f"""select prescriber_id, {", ".join(_scaled(c) for c in MODEL_FEATURES)}
  from scored cross join (select {", ".join(
    f"avg({c}) as {c}_mean, stddev_pop({c}) as {c}_sd" for c in MODEL_FEATURES)}
  from scored where not ({_HOLDOUT}))"""

_LOGITS = ["avg_risk_score", "opioid_rate / 50", "avg_patient_age / 50"]
_EXPS = [f"exp({x})" for x in _LOGITS]
_SOFTMAX = ", ".join(
    f"round({e} / ({' + '.join(_EXPS)}), 9) as {n}" for e, n in zip(_EXPS, ("p_low", "p_medium", "p_high"))
)

_HISTOGRAM = """select cast(b.range as integer) as bin, round(lo + b.range * ((hi - lo) / 50), 6) as low,
  round(lo + (b.range + 1) * ((hi - lo) / 50), 6) as high,
  count(case when least(floor((v - lo) / (hi - lo) * 50), 49) = b.range then 1 end) as n_rows
  from range(50) b cross join (select min("Payment_Amount") as lo, max("Payment_Amount") as hi from payments)
  cross join (select "Payment_Amount" as v from payments) group by all"""

_AGAIN = f"{_bucket(chr(34) + 'NPI' + chr(34))} < 1000"
_KEYED = f"(select event_id, {KEY_TEXT} as \"NPI\" from events)"
_NUMBER = 'try_cast("NPI" as bigint)'

_FEATURES_PRESENT = [c for c in MODEL_FEATURES if c in PRESCRIBER_NUMERIC]
_FEATURES_ABSENT = ", ".join(f"{ZERO} as {c}" for c in MODEL_FEATURES if c not in PRESCRIBER_NUMERIC)
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_STORED = "(select * exclude (fraud_label) from surrogate where total_claims > 0)"

# MurmurHash3 (32 bit) of a non-negative bigint in unsigned arithmetic, one step per subquery.
_TWO_32 = 2**32


def _times(a: str, factor: int) -> str:
    return f"({a} * {factor}) % {_TWO_32}"


def _rotated(a: str, bits: int) -> str:
    return f"({a} * {2**bits}) % {_TWO_32} + {a} // {2 ** (32 - bits)}"


def _murmur_steps(key: str, source: str, seed: int = 42) -> list[str]:
    steps = [("low", f"cast({key} as ubigint) % {_TWO_32}"), ("high", f"cast({key} as ubigint) // {_TWO_32}")]
    state = f"cast({seed} as ubigint)"
    for word in ("low", "high"):
        steps.append((f"{word}1", _times(word, 0xCC9E2D51)))
        steps.append((f"{word}2", _rotated(f"{word}1", 15)))
        steps.append((f"{word}3", f"xor({state}, {_times(f'{word}2', 0x1B873593)})"))
        steps.append((f"{word}4", _rotated(f"{word}3", 13)))
        steps.append((f"{word}5", f"({word}4 * 5 + {0xE6546B64}) % {_TWO_32}"))
        state = f"{word}5"
    steps += [("f1", f"xor({state}, cast(8 as ubigint))"), ("f2", "xor(f1, f1 // 65536)")]
    steps += [("f3", _times("f2", 0x85EBCA6B)), ("f4", "xor(f3, f3 // 8192)")]
    steps += [("f5", _times("f4", 0xC2B2AE35)), ("hashed", "xor(f5, f5 // 65536)")]
    parts, previous = [], source
    for i, (name, expression) in enumerate(steps):
        parts.append(f"h{i} as (select *, {expression} as {name} from {previous})")
        previous = f"h{i}"
    return [*parts, f"hashed as (select * from {previous})"]


_SIGNED = f"(case when hashed >= {2**31} then cast(hashed as bigint) - {_TWO_32} else cast(hashed as bigint) end)"

# --- lines, windows, stored profiles, exact sizes, the resumed job ------------------------

_RAW_NAMES = {clean: raw for raw, clean in PRESCRIBER_COLUMNS.items()}


def _misfit(c: str) -> str:
    return f"case when {c} is not null and try_cast({c} as double) is null then '{_RAW_NAMES[c]}=' || {c} end"


_MISFITS = f"concat_ws('|', {', '.join(_misfit(c) for c in PRESCRIBER_NUMERIC)})"

_TIGHT = SCORING_RANGES | {"total_claims": (0.0, 100.0), "payment_variability": (0.0, 2.0), "peer_deviation_score": (0.0, 1.0)}


def _scored_error(column: str, low: float, high: float) -> str:
    return f"""case when {column} is not null and prescriber_id % 50 = 0 then '{column}: enter a valid number.'
      when coalesce({column}, 0) < {low} or coalesce({column}, 0) > {high} then '{column}: must be between {low:,.0f} and {high:,.0f}.' end"""


_SCORED_ERRORS = f"concat_ws('|', {', '.join(_scored_error(c, low, high) for c, (low, high) in _TIGHT.items())})"

_HOME = """homes as (
  select h.state as home from payments q join prescribers h on h.prescriber_id = cast(q."NPI" as bigint) where h.total_claims > 0)"""

_BALANCE_ORDER = "substr(sha256(concat('balance:', cast(prescriber_id as varchar))), 1, 16)"


def _exact(source: str, label: str) -> str:
    """Every class of ``source`` with the mean class size, or ten times its own: whole copies, and one more by hash order."""
    return f"""sized as (
  select {label}, count(*) as n, least((select sum(k) // count(*) from (select count(*) as k from {source} group by {label})), 10 * count(*)) as size
  from {source} group by {label}), placed as (
  select s.*, row_number() over (partition by s.{label} order by {_BALANCE_ORDER}) as place from {source} s), drawn as (
  select p.*, size // n + case when place <= size % n then 1 else 0 end as copies from placed p join sized z on z.{label} = p.{label})"""


_TRAIN = f"train as (select prescriber_id, {_TIER_CODE} as tier from scored where not ({_HOLDOUT}))"
_JUDGED = f"{_bucket("concat('validation:', cast(prescriber_id as varchar))")} < 2000"
_EVERY_TABLE = {
    "clean_prescribers": ("clean", "prescribers"),
    "clean_payments": ("clean", "payments"),
    "payment_summary": ("aggregate", "summary"),
    "prescriber_level": ("aggregate", "level"),
    "payment_level": ("aggregate", "merged"),
    "peer_average": ("features", "peers"),
    "prescriber_level_enriched": ("features", "enriched"),
    "scored_prescribers": ("score", "scored"),
}

ORACLES: dict[str, str] = {
    "scan_prescribers": _with([CLAIMS, RAW], "select * from raw"),
    "scan_payments": _with([RAW_PAYMENTS], "select * from raw_payments"),
    "clean_payments": _with(
        [UNTIDY_PAYMENTS],
        f'select * exclude ("Zip", "Payment_Amount"), {_zip5(chr(34) + "Zip" + chr(34))} as "Zip", '
        f'{_currency(chr(34) + "Payment_Amount" + chr(34))} as "Payment_Amount" from untidy_payments',
    ),
    "sink_roundtrip": _with(_PEOPLE, "select * from prescribers"),
    "bounded_read": _with(_PEOPLE, "select * from prescribers order by prescriber_id limit 100"),
    "align_scoring_schema": _with(
        _PEOPLE,
        "select cast(prescriber_id as varchar) as prescriber_id, "
        + ", ".join(SCORING_ID_COLUMNS[1:])
        + ", "
        + ", ".join(c if c in PRESCRIBER_NUMERIC else f"cast(null as double) as {c}" for c in SCORING_RANGES)
        + " from prescribers",
    ),
    "project_prescribers": _with([CLAIMS, RAW, UNTIDY], "select * from untidy"),
    "project_payments": _with([UNTIDY_PAYMENTS], "select * from untidy_payments"),
    "select_present": _with(_PEOPLE, "select prescriber_id, state, zip from prescribers"),
    "ensure_features": _with(
        [CLAIMS, RAW],
        f"select prescriber_id, {', '.join(f'coalesce({c}, {ZERO}) as {c}' for c in _FEATURES_PRESENT)}, "
        f"{_FEATURES_ABSENT} from raw",
    ),
    "union_parts": _with(_SURROGATE, "select prescriber_id, fraud_label from surrogate"),
    "clean_amount": rf"""select event_id, amount_text, {_currency("amount_text")} as amount,
  coalesce(try_cast(nullif(regexp_extract(replace(amount_text, ',', ''), '-?\d+(?:\.\d+)?', 0), '') as double), {ZERO})
    as strict_amount from (select event_id, {AMOUNT_TEXT} as amount_text from events)""",
    "clean_zip": f"""select event_id, zip_text, {_zip5("zip_text")} as zip
  from (select event_id, {ZIP_TEXT} as zip_text from events)""",
    "guard_numeric": _with(
        [CLAIMS, RAW, UNTIDY],
        f"select prescriber_id, {', '.join(_guarded(c) for c in PRESCRIBER_NUMERIC)} from untidy",
    ),
    "fill_strings": _with(
        [CLAIMS, RAW], f"select prescriber_id, {', '.join(f'coalesce({c}, $$NA$$) as {c}' for c in _TEXT)} from raw"
    ),
    "null_to_zero": _with(
        [CLAIMS, RAW],
        f"select prescriber_id, {', '.join(f'coalesce({c}, {ZERO}) as {c}' for c in PRESCRIBER_NUMERIC)} from raw",
    ),
    "coerce_numeric": _with(
        [CLAIMS, RAW, UNTIDY],
        "select prescriber_id, "
        + ", ".join(
            f"case when regexp_matches({c}, '{_DECIMAL}') then try_cast({c} as double) else {ZERO} end as {c}"
            for c in _FEATURES_PRESENT
        )
        + f", {_FEATURES_ABSENT} from untidy",
    ),
    "safe_key_cast": f'select event_id, "NPI", {_NUMBER} as npi_number from {_KEYED}',
    "filter_valid_keys": f'select event_id, "NPI", {_NUMBER} as npi_number from {_KEYED} where {_NUMBER} is not null',
    "audit_bad_keys": f'select event_id, "NPI" from {_KEYED} where {_NUMBER} is null',
    "audit_non_numeric": _with(
        [UNTIDY_PAYMENTS],
        r"""select 'Payment_Amount' as column_name,
    count(case when not regexp_matches("Payment_Amount", '^-?\d+(\.\d+)?$') then 1 end) as n_bad from untidy_payments
  union all select 'Zip', count(case when not regexp_matches("Zip", '^\d+$') then 1 end) from untidy_payments""",
    ),
    "audit_post_clean": rf"""select 'Payment_Amount' as column_name, cast(0 as bigint) as n_bad
  union all select 'Zip', count(case when not regexp_matches({_zip5("z")}, '^\d{{5}}$') then 1 end)
  from (select {ZIP_TEXT} as z from events)""",
    "audit_residual_chars": _with(
        [CLAIMS, RAW, UNTIDY],
        _per_column(
            PRESCRIBER_NUMERIC,
            lambda c: f"select '{c}' as column_name, count(case when "
            rf"regexp_replace({c}, '[0-9.+\-Ee]', '', 'g') <> '' then 1 end) as n_bad from untidy",
        ),
    ),
    "validate_ranges": _with(
        [CLAIMS, RAW, UNTIDY],
        f"select prescriber_id, {_RANGE_ERRORS} as errors, {_RANGE_ERRORS} = '' as is_valid from untidy",
    ),
    "payment_aggregates": _with([PAYMENTS, SUMMARY], "select * from summary"),
    "prescriber_level": _with(_LEVEL, "select * from level"),
    "payment_level": _with(_MERGED, "select * from merged"),
    "join_predictions": _with(
        _SURROGATE,
        f"""select u.prescriber_id, u.provider_type as provider_type_x, u.state as state_x, u.avg_patient_age,
  s.provider_type as provider_type_y, s.state as state_y, s.total_claims, s.prediction,
  case s.prediction when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' end as predicted_category
  from prescribers u left join {_STORED} s on s.prescriber_id = u.prescriber_id""",
    ),
    "lookup_predictions": _with(
        _SURROGATE,
        f"""select a.prescriber_id, s.provider_type, s.state, s.total_claims, s.prediction,
  s.prescriber_id is not null as matched from (select distinct "NPI" as prescriber_id from {_KEYED}) a
  left join {_STORED} s on cast(s.prescriber_id as varchar) = a.prescriber_id""",
    ),
    "features": _with(
        [*_LEVEL, ENRICHED],
        """select prescriber_id, payment_per_claim, payment_to_drug_cost_ratio, opioid_claim_ratio,
  antibiotic_claim_ratio, high_opioid_flag, payment_variability, high_payment_flag, female_to_male_ratio,
  elderly_focus_flag, adjusted_risk_payment from enriched""",
    ),
    "peer_average": _with(
        _LEVEL,
        "select provider_type, round(avg(avg_payment_amount), 6) as peer_avg_payment from level group by provider_type",
    ),
    "peer_deviation": _with(
        [*_LEVEL, ENRICHED],
        "select prescriber_id, provider_type, peer_avg_payment, peer_deviation_score from enriched",
    ),
    "scored_prescribers": _with(_SCORED, "select * from scored order by prescriber_id"),
    "risk_score": _with(_SCORED, "select prescriber_id, fraud_risk_score, fraud_risk_category from scored"),
    "risk_distribution": _with(
        _SCORED, "select fraud_risk_category, count(*) as n_rows from scored group by 1 order by 2 desc, 1"
    ),
    "fired_rules": _with([*_SCORED, FIRED], "select * from fired"),
    "rule_hits": _with(
        [*_SCORED, FIRED],
        """select rule_name, count(*) as n_rows from fired group by 1 union all
  select 'none', count(*) from scored where prescriber_id not in (select prescriber_id from fired) having count(*) > 0""",
    ),
    "scored_preview": _with(
        _SCORED,
        """select prescriber_id, provider_type, state, total_claims, total_payment_amount, payment_to_drug_cost_ratio,
  opioid_claims, peer_deviation_score, fraud_risk_score, fraud_risk_category
  from scored order by prescriber_id limit 10""",
    ),
    "dataset_shape": _with(_MERGED, "select count(*) as n_rows, 34 as n_columns from merged"),
    "missing_values": _with(
        _MERGED,
        _per_column(
            _MERGED_TYPES,
            lambda c: f"select '{c}' as column_name, count(case when \"{c}\" is null then 1 end) as n_missing from merged",
        ),
    ),
    "summary_stats": _with(
        _MERGED,
        _per_column(
            _MERGED_NUMERIC,
            lambda c: f"select '{c}' as column_name, count(\"{c}\") as n_values, {_stats(c)} from merged",
        ),
    ),
    "distinct_counts": _with(
        _MERGED,
        _per_column(
            _MERGED_TYPES,
            lambda c: f"select '{c}' as column_name, cast({_distinct(c)} as bigint) as n_distinct from merged",
        ),
    ),
    "profile_columns": _with(_MERGED, _per_column(_MERGED_TYPES, _profile)),
    "correlation_matrix": _with(_MERGED, _correlations()),
    "amount_stats": _with(
        [PAYMENTS],
        """select round(avg("Payment_Amount"), 6) as mean, round(stddev_samp("Payment_Amount"), 6) as stddev
  from payments""",
    ),
    "outliers_3sigma": _with(
        [PAYMENTS],
        """select "NPI", "Payment_Amount", "Payment_Date" from payments
  cross join (select avg("Payment_Amount") as m, stddev_samp("Payment_Amount") as s from payments)
  where "Payment_Amount" > m + 3 * s or "Payment_Amount" < m - 3 * s""",
    ),
    "duplicate_rows": _with(
        [PAYMENTS],
        f"""select cast((select count(*) from payments) + (select count(*) from payments where {_AGAIN}) - count(*) as bigint)
  as n_duplicates from (select distinct * from payments)""",
    ),
    "distinct_rows": _with([PAYMENTS], "select distinct * from payments"),
    "histogram": _with([PAYMENTS], _HISTOGRAM),
    "top_states": _with([PAYMENTS], _top("State", "payments")),
    "top_specialties": _with([PAYMENTS], _top("Specialty", "payments")),
    "top_zips": _with([PAYMENTS], _top("Zip", "payments")),
    "top_provider_types": _with(_MERGED, _top("provider_type", "merged")),
    "sample_hash": _with(
        _PEOPLE, f"select prescriber_id, state from prescribers where {_bucket(_SALTED)} < 2000"
    ),
    "resample_plan": _with([*_SURROGATE, _PLAN], "select * from plan"),
    "resample_hash": _with([*_SURROGATE, _PLAN], _RESAMPLED),
    "sha_bucket": f"select c_custkey, {_bucket('c_custkey')} as bucket from customer",
    "split_sha": _with(_PEOPLE, f"select prescriber_id, {_HOLDOUT} as is_holdout from prescribers"),
    "split_murmur": _with(
        [*_PEOPLE, *_murmur_steps("prescriber_id", "prescribers")],
        f"select prescriber_id, (({_SIGNED} % 10000) + 10000) % 10000 >= 8000 as is_holdout from hashed",
    ),
    "standardize": _with(_SCORED, _STANDARDIZED),
    "label_encode": _with(
        _SCORED,
        """select prescriber_id, case fraud_risk_category when 'Low' then 0 when 'Medium' then 1 when 'High' then 2 end
  as fraud_label from scored""",
    ),
    "label_decode": """select c_custkey, c_custkey % 5 as code, case c_custkey % 5 when 0 then 'Low' when 1 then 'Medium'
  when 2 then 'High' when 3 then '3.0' else '4.0' end as tier from customer""",
    "softmax_scores": _with(_PEOPLE, f"select prescriber_id, {_SOFTMAX} from prescribers"),
    "assemble": _with(
        _SCORED,
        "select prescriber_id, fraud_risk_score as fraud_label, "
        + ", ".join(f"{c} as x{i}" for i, c in enumerate(MODEL_FEATURES))
        + " from scored",
    ),
    "confusion_matrix": _with(
        _SURROGATE, "select fraud_label, prediction, count(*) as n_rows from surrogate group by 1, 2"
    ),
    "confusion_matrix_dense": _with(
        _SURROGATE,
        "select k as label, "
        + ", ".join(
            f"count(case when fraud_label = k and prediction = {p} then 1 end) as predicted_{p}" for p in range(len(TIERS))
        )
        + ", cast(0 as bigint) as predicted_other from surrogate cross join (values (0), (1), (2)) v(k) group by k",
    ),
    "eval_overall": _with(_METRICS, f"select {_ACCURACY} as accuracy, {_weighted('f1')} as weighted_f1, cast(0 as bigint) as n_outside from metrics"),
    "eval_per_class": _with(_METRICS, 'select label, tp, fp, fn, "precision", recall, f1 from metrics'),
    "eval_macro_f1": _with(_METRICS, f"select {_mean_of('f1')} as macro_f1 from metrics"),
    "classification_report": _with(_METRICS, _REPORT),
    "sample_uniform_facts": "select cast(0 as bigint) as n_repeated, cast(0 as bigint) as n_strangers",
    "split_random_facts": "select count(*) as n_rows, count(distinct c_custkey) as n_keys from customer",
    "resample_random_facts": _with(_SURROGATE, "select distinct fraud_label, cast(0 as bigint) as n_strangers from surrogate"),
    "score_holdout_facts": _with(
        _SCORED, f"select prescriber_id, {_TIER_CODE} as fraud_label, true as has_class from scored where {_HOLDOUT}"
    ),
    "predictions_facts": _with(
        _SCORED, f"select prescriber_id, provider_type, state, total_claims, fraud_risk_category from scored where {_HOLDOUT}"
    ),
    "probability_facts": _with(_SCORED, "select cast(prescriber_id as varchar) as prescriber_id, true as adds_up from scored"),
    "importance_facts": f"""select model, cast({len(MODEL_FEATURES)} as bigint) as n_features, cast(1 as double) as total
  from (values ('forest'), ('boosted')) v(model)""",
    "sample_then_split": _with(
        _PEOPLE, f"select prescriber_id, {_HOLDOUT} as is_holdout from prescribers where {_bucket(_SALTED)} < 2000"
    ),
    "model_roundtrip": "select count(*) as n_rows, cast(0 as bigint) as n_different from customer",
    "scan_checked": _with(
        [CLAIMS, RAW, UNTIDY], f"select prescriber_id, {_MISFITS} as reasons, {_MISFITS} = '' as accepted from untidy"
    ),
    "reject_counts": _with(
        [CLAIMS, RAW, UNTIDY],
        "select * from ("
        + " union all ".join(
            f"select '{_RAW_NAMES[c]}' as column_name, 'double' as wanted, "
            f"count(case when {c} is not null and try_cast({c} as double) is null then 1 end) as n_values from untidy"
            for c in PRESCRIBER_NUMERIC
        )
        + ") where n_values > 0",
    ),
    "validate_scored": _with(_SCORED, f"select prescriber_id, {_SCORED_ERRORS} as errors, {_SCORED_ERRORS} = '' as is_valid from scored"),
    "peer_window": _with(
        _LEVEL,
        """select prescriber_id, provider_type, round(m, 6) as peer_avg_payment,
  round(case when m > 0 then avg_payment_amount / m else cast(0 as double) end, 4) as peer_deviation_score
  from (select *, avg(avg_payment_amount) over (partition by provider_type) as m from level)""",
    ),
    "peer_extremes": _with(
        [PAYMENTS],
        """select "NPI", "State", "Payment_Form", "Payment_Amount", count("Payment_Amount") over w as count_amount,
  round(avg("Payment_Amount") over w, 6) as avg_amount, min("Payment_Amount") over w as min_amount,
  max("Payment_Amount") over w as max_amount from payments window w as (partition by "State", "Payment_Form")""",
    ),
    "merged_profile": _with(_MERGED, f"select * exclude (n_distinct) from ({_per_column(_MERGED_TYPES, _profile)})"),
    "sketched_distinct": _with(
        _MERGED,
        _per_column(
            _MERGED_TYPES,
            lambda c: f"select '{c}' as column_name, cast({_distinct(c)} as bigint) as n_distinct, true as is_near from merged",
        ),
    ),
    "top_known_states": _with([*_PEOPLE, PAYMENTS, _HOME], _top("home", "homes")),
    "top_known_zips": _with([RAW_PAYMENTS], _top("Zip", "raw_payments where \"Zip\" is not null")),
    "resample_exact": _with(
        [*_SURROGATE, _exact("surrogate", "fraud_label")],
        """select prescriber_id, fraud_label, g.copy from drawn
  join (select cast(unnest(range(1, 12)) as bigint) as copy) g on g.copy <= copies""",
    ),
    "tuning_sides": _with(
        [*_SCORED, _TRAIN, _exact("train", "tier")],
        f"""select cast(sum(case when {_JUDGED} then 0 else copies end) as bigint) as n_fitting,
  cast(sum(case when {_JUDGED} then copies else 0 end) as bigint) as n_validation,
  count(case when not {_JUDGED} then 1 end) as fitting_keys, count(case when {_JUDGED} then 1 end) as validation_keys,
  cast(0 as bigint) as keys_on_both from drawn where copies > 0""",
    ),
    "bundle_signature": _with(
        _SCORED,
        "select cast(position as integer) as position, feature, 3 as n_classes, "
        f"(select count(*) from scored where not ({_HOLDOUT})) as n_train from (values "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(MODEL_FEATURES))
        + ") v(position, feature)",
    ),
    "model_report_facts": _with(
        [*_SCORED, f"held as (select fraud_risk_category as tier from scored where {_HOLDOUT})"],
        """select name as class_name, case when name in ('Low', 'Medium', 'High') then (select count(*) from held where tier = name)
    else (select count(*) from held) end as support, true as are_shares, true as agree
  from (values ('Low'), ('Medium'), ('High'), ('accuracy'), ('macro avg'), ('weighted avg')) v(name)""",
    ),
    "batch_score_facts": _with(_SCORED, "select prescriber_id, state, true as adds_up, true as is_same from scored"),
    "top_features_facts": _with(
        _SCORED,
        f"select prescriber_id, cast(5 as bigint) as n_features, 5 as last_rank, true as all_own from scored where {_HOLDOUT}",
    ),
    "etl_resumed": _with(_SCORED, "select * from scored"),
    "etl_progress": _with(
        [*_SCORED, MERGED],
        " union all ".join(
            f"select '{stage}' as stage, '{table}' as table_name, (select count(*) from {source}) as n_rows, "
            f"{str(stage in ('features', 'score')).lower()} as made_again"
            for table, (stage, source) in _EVERY_TABLE.items()
        ),
    ),
    "sample_then_train_facts": _with(
        _SCORED,
        f"""select prescriber_id, {_TIER_CODE} as fraud_label, true as has_class from scored
  where {_HOLDOUT} and {_bucket(_SALTED)} < 2000""",
    ),
}
