"""Secret scans over a ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its content.
The ledger holds one row per (blob, rule, rule version) ever scanned, with the spans
found. A run scans only pairs that the ledger lacks, once per blob however many
paths and versions hold it, and joins findings back to all of them. Raising a rule's
version scans old blobs again with that rule alone.

Spans come from two extractions of ``\\G(.*?)(?:rule)``: the text before each match
and the match itself; running sums of their lengths are the spans. ``\\G`` ties each
match to the end of the last one, so a text is read once whatever its length.

Defined cases: a null text is the empty blob; a null path or version is a value of
its own; repeated rows are each reported; an empty table gives empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, table
from riskloom.sources.staging import stage

LEDGER = {"blob": "binary", "rule": "string", "rule_version": "int", "spans": "array<struct<start:bigint,end:bigint>>"}


class Rule(NamedTuple):
    """``value`` is the group whose length must reach ``least``; 0 is the whole match."""

    name: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1


#: The base rules, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds of credentials: key blocks, signed web tokens, credentials inside addresses.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("address", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/:@]{1,200}@"),
)
RULES = BASE_RULES + MORE_RULES


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in LEDGER.items()])


def find_spans(text: Column, rule: Rule) -> Column:
    """Leftmost, non-overlapping matches as (start, end) in code points; matches with too short a value go."""
    stepped = rf"\G(?s:(.*?))({rule.pattern})"
    gaps = F.regexp_extract_all(text, F.lit(stepped), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(stepped), F.lit(2))
    lengths = F.transform(found, lambda m: F.length(m).cast("bigint"))
    if rule.value:
        values = F.transform(F.regexp_extract_all(text, F.lit(stepped), F.lit(2 + rule.value)), F.length)
    else:
        values = lengths
    steps = F.arrays_zip(F.transform(gaps, lambda g: F.length(g).cast("bigint")).alias("gap"), lengths.alias("own"), values.alias("value"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda state, s: F.struct(
            (state["at"] + s["gap"] + s["own"]).alias("at"),
            F.when(
                s["value"] >= rule.least,
                F.concat(
                    state["spans"],
                    F.array(F.struct((state["at"] + s["gap"]).alias("start"), (state["at"] + s["gap"] + s["own"]).alias("end"))),
                ),
            ).otherwise(state["spans"]).alias("spans"),
        ),
        lambda state: state["spans"],
    )
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def scan_versions(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` has path, version, text. Returns the rows to add to the ledger, and each version's findings.

    Findings have path, version, blob and ``spans``: an array of (start, rule number, end, rule).
    """
    versions = only(versions, path="string", version="bigint", text="string")
    address = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    addressed = stage(versions.select("path", "version", address.alias("blob")), "addressed")
    known = only(ledger, blob="binary", rule="string", rule_version="int")
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    blobs = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("from"))
    pairs = blobs.select("blob", "from", F.explode(wanted).alias("pair")).select("blob", "from", "pair.*")
    unseen = pairs.join(known, ["blob", "rule", "rule_version"], "left_anti")
    pending = stage(
        unseen.groupBy("blob").agg(F.first("from").alias("from"), F.collect_set("rule").alias("rules"))
        .select("blob", "from.path", "from.version", "rules"),
        "pending",
    )
    one = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text"), address.alias("blob"))
    here = (
        one["blob"].eqNullSafe(pending["blob"])
        & one["path"].eqNullSafe(pending["path"])
        & one["version"].eqNullSafe(pending["version"])
    )
    held = one.join(pending, here).select(pending["blob"], "rules", "text")
    scanned = held.select(
        "blob",
        F.filter(
            F.array(*[
                F.when(
                    F.array_contains("rules", r.name),
                    F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), find_spans(F.col("text"), r).alias("spans")),
                )
                for r in rules
            ]),
            lambda x: x.isNotNull(),
        ).alias("found"),
    )
    scanned = scanned.groupBy("blob").agg(F.first("found").alias("found"))
    added = stage(scanned.select("blob", F.explode("found").alias("x")).select("blob", "x.*"), "ledger")

    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    whole = added.unionByName(ledger.select(*added.columns))
    hits = (
        whole.where(F.col("rule_version") == current[F.col("rule")])
        .select("blob", "rule", F.explode("spans").alias("span"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("span.start", order[F.col("rule")].alias("kind"), "span.end", "rule"))).alias("spans"))
    )
    findings = addressed.join(stage(hits, "hits"), "blob", "left")
    return added, findings


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the first versions of their paths, against a ledger that is still empty."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    _, findings = scan_versions(versions, empty_ledger(spark))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,rule:string>>"))
    base = F.filter(spans, lambda s: s["kind"] < len(BASE_RULES))
    return findings.select(
        F.col("path").cast("bigint").alias("doc_id"),
        *[_count(spans, kind).alias(f"n_{rule.name}") for kind, rule in enumerate(BASE_RULES)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )

