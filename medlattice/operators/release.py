"""Release gates over evidence tables, the decision they lead to, and fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each worst status means.
DECISIONS = {"BLOCK": "BLOCKED", "REVIEW": "REVIEW REQUIRED", "PASS": "READY"}


def gate(gate_id: str, failures: DataFrame, otherwise: str) -> DataFrame:
    """(gate_id, status): PASS where there are no failures."""
    return failures.agg(F.count("*").alias("n")).select(F.lit(gate_id).alias("gate_id"), F.when(F.col("n") == 0, "PASS").otherwise(otherwise).alias("status"))


def decision(gates: DataFrame) -> DataFrame:
    """(decision): the worst status decides; no gates decide nothing, so they need review."""
    worst = gates.agg(F.max(F.when(F.col("status") == "BLOCK", 2).when(F.col("status") == "REVIEW", 1).when(F.col("status") == "PASS", 0).otherwise(2)).alias("w"))
    return worst.select(F.when(F.col("w") == 2, DECISIONS["BLOCK"]).when(F.col("w") == 0, DECISIONS["PASS"]).otherwise(DECISIONS["REVIEW"]).alias("decision"))


def fingerprint(member: str) -> Column:
    """16 hexadecimal digits over a group's distinct members in text order, joined by line feeds: the format of evidence registers. A group
    is one task's array here; cohorts of more than some million members take tree_fingerprint."""
    text = F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "\n")
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def tree_fingerprint(df: DataFrame, by: Sequence[str], member: str, block: int = 1024) -> DataFrame:
    """(by..., members, depth, tree_fingerprint) of groups of any size, by a hash tree that needs no task with all members.

    Format: h is the lower-case hex sha256 of a member's UTF-8 text; distinct members count, nulls don't. depth is the least d with
    members <= block * 16**d. A node is a prefix of hex digits. The value of a prefix of depth digits is the sha256 of its members' h in
    ascending order, put together; that of a shorter prefix is the sha256 of, for each child that has members, its last digit and its value,
    by ascending digit. The fingerprint is the empty prefix's value, its first 16 digits in upper case. A group whose members are all null
    has the value of no members. Two sets differ in the values of the prefixes of what differs, and on the way up, nowhere else.
    """
    h = F.sha2(F.col(member).cast("string"), 256).alias("_h")
    m = df.select(*by, h).distinct()
    sizes = m.groupBy(*by).agg(F.count("_h").alias("members"))
    depth = F.when(F.col("members") <= block, 0)
    for d in range(1, 12):
        depth = depth.when(F.col("members") <= block * 16**d, d)
    sizes = sizes.withColumn("depth", depth)
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    level = m.alias("m").join(sizes.alias("s"), same).select(*(F.col(f"m.{c}") for c in by), "depth", F.coalesce(F.left("_h", F.col("depth")), F.lit("")).alias("_p"), "_h")
    text = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    level = level.groupBy(*by, "depth", "_p").agg(text(F.col("_h")).alias("_v"))  # `block` or so
    for d in range(deepest, 0, -1):
        below = level.where(F.length("_p") == d)
        child = F.concat(F.right("_p", F.lit(1)), "_v")
        up = below.groupBy(*by, "depth", F.left("_p", F.lit(d - 1)).alias("_p")).agg(text(child).alias("_v"))  # 16 at most
        level = level.where(F.length("_p") < d).unionByName(up)
    root = level.select(*by, F.upper(F.left("_v", F.lit(16))).alias("tree_fingerprint"))
    return sizes.alias("m").join(root.alias("s"), same).select(*(F.col(f"m.{c}") for c in by), "members", "depth", "tree_fingerprint")


def register_fingerprint(cohorts: DataFrame, gates: DataFrame) -> str:
    """SHA-256 of the registers as canonical JSON; both are small by construction (a row for each cohort and gate)."""
    rows = lambda df: sorted((json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect()))
    return hashlib.sha256(json.dumps([rows(cohorts), rows(gates)], separators=(",", ":")).encode()).hexdigest()


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, sha256) of files with line ends made one."""
    files = spark.read.format("binaryFile").load(paths)
    text = F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    return files.select("path", F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256"))


def trial_gates(evidence: dict[str, DataFrame], metrics: dict) -> DataFrame:
    """The seven gates: (gate_id, status).

    evidence: subjects, dm, trial_defects, queries, sdtm_conformance, fhir_defects, fhir_rejects, uat. Planted document defects are
    compared with what was rejected, not only counted.
    """
    spark = evidence["subjects"].sparkSession
    keys = ["subject_id", "visit_id", "form_id", "record_num", "item_oid"]
    differ = lambda a, b: a.subtract(b).unionByName(b.subtract(a))
    planted = evidence["fhir_defects"]
    unseen = planted.join(evidence["fhir_rejects"].select("source_ref", "line_number", "reason"), ["source_ref", "line_number"], "left")
    unseen = unseen.where(F.col("reason").isNull() | ~F.contains("reason", "expected_reason_fragment"))
    source = metrics.get("source") or {}
    traced = len(str(source.get("jar_sha256") or "")) == 64 and bool(source.get("seed"))
    one = spark.range(1)
    gates = [
        gate("COHORT-01", differ(evidence["subjects"].select("subject_id"), evidence["dm"].select(F.col("SUBJID").alias("subject_id"))), "BLOCK"),
        gate("QUERY-01", differ(evidence["trial_defects"].select(*keys, F.col("expected_check").alias("check_id")), evidence["queries"].select(*keys, "check_id")), "BLOCK"),
        gate("SDTM-01", evidence["sdtm_conformance"], "BLOCK"),
        gate("FHIR-01", unseen if not planted.isEmpty() else one, "BLOCK"),
        gate("FHIR-02", one.where(F.lit(not metrics.get("row_ledger", False))), "REVIEW"),
        gate("PROV-01", one.where(F.lit(not traced)), "BLOCK"),
        gate("UAT-01", evidence["uat"].where("coalesce(trim(pass_fail), '') = ''") if not evidence["uat"].isEmpty() else one, "REVIEW"),
    ]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def source_ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, n_rows) of each evidence table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


#: What a policy must have.
POLICY_KEYS = ("control_id", "study_id", "release_id", "cohorts", "required_evidence", "reverification_triggers", "demonstration_boundary")


def load_policy(text: str, known: Sequence[str] = ("1",)) -> dict:
    """A policy from JSON text; an unknown version or a missing key is an error."""
    policy = json.loads(text)
    if str(policy.get("schema_version")) not in known:
        raise ValueError(f"unknown schema_version {policy.get('schema_version')!r}")
    if missing := sorted(set(POLICY_KEYS) - policy.keys()):
        raise ValueError(f"policy lacks {', '.join(missing)}")
    return policy


def reverification_probe(evidence: dict[str, DataFrame], metrics: dict) -> dict[str, object]:
    """Whether a release closes when its population changes: the gates and decisions with the evidence as it is, and with the first subject
    of DM left out. Only frames are changed, no table."""
    first = evidence["dm"].agg(F.min("SUBJID").alias("_first"))
    changed = dict(evidence, dm=evidence["dm"].join(F.broadcast(first), F.col("SUBJID") == F.col("_first"), "left_anti"))
    said = []
    for e in (evidence, changed):
        gates = trial_gates(e, metrics)
        said.append(({r.gate_id: r.status for r in gates.collect()}, decision(gates).first().decision))
    (before, open_), (after, closed) = said
    return {"decision_before": open_, "decision_after": closed, "changed_gates": [g for g in before if before[g] != after[g]], "cohort_gate_before": before["COHORT-01"], "cohort_gate_after": after["COHORT-01"]}
