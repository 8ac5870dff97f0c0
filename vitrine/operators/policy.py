"""Gates, publication, lifecycle guards, project constraints and pair compatibility, for all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
ACCEPTABLE_LICENSES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense")
GATES = (("critical_vulnerability", True), ("license_compatibility", True), ("missing_provenance", True), ("unsafe_declared_permissions", False))
CONFIDENCE_THRESHOLD = 0.6
GUARDS = ("current_revision", "required_scorecard", "confidence_threshold", "no_blocking_gate", "source_binding", "summary", "interfaces")
TRANSITIONS = (("candidate", "analyzed"), ("analyzed", "verified"), ("verified", "cataloged"))
GPU_HINTS = ("gpu", "cuda", "nvidia", "rocm", "tensorrt")
BROKER_TOPICS = ("celery", "airflow", "kafka", "rabbitmq", "cron", "scheduler")
REMOTE_RUNTIMES = ("http_endpoint", "mcp_http", "mcp_sse")


def gate_columns(more=()) -> list[Column]:
    """A struct gate_name, status, is_blocking, reason, detail (JSON) for each gate, over scoring.version_facts; more are gates
    of plug-ins, whose facts are there as well."""
    ids, allowed = F.col("spdx_ids"), F.array(*map(F.lit, ACCEPTABLE_LICENSES))
    ok, none = F.arrays_overlap(ids, allowed), F.col("n_licenses") == 0
    unknown = (F.size(ids) == 1) & F.array_contains(ids, "unknown")
    secrets, setup = F.col("n_secrets") > 0, F.col("n_setup_py") > 0
    bare, count = F.lit("{}"), lambda c: F.struct(F.col(c).alias("count"))
    told = F.struct(ids.alias("spdx_ids"))
    refused = F.struct(ids.alias("spdx_ids"), F.array_sort(allowed).alias("allowlist"))
    found = F.struct(F.col("n_secrets").alias("count"), F.col("secret_names").alias("patterns"))
    gates = {
        "license_compatibility": (
            F.when(ok, "pass").otherwise("fail"),
            F.when(none, "no license evidence found").when(unknown, "license file present but SPDX id unknown").when(ok, "acceptable license").otherwise("no acceptable license detected"),
            F.when(none, bare).when(unknown | ok, F.to_json(told)).otherwise(F.to_json(refused)),
        ),
        "critical_vulnerability": (
            F.when(secrets, "fail").otherwise("pass"),
            F.when(secrets, F.concat(F.col("n_secrets").cast("string"), F.lit(" secret indicator(s) in source"))).otherwise("no secret indicators found"),
            F.when(secrets, F.to_json(found)).otherwise(bare),
        ),
        "missing_provenance": (
            F.when(F.col("has_binding") & F.col("has_hash"), "pass").otherwise("fail"),
            F.when(~F.col("has_binding"), "no source binding").when(~F.col("has_hash"), "no content hash").otherwise("binding and content hash present"),
            bare,
        ),
        "unsafe_declared_permissions": (
            F.when(setup, "warn").otherwise("pass"),
            F.when(setup, "setup.py present").otherwise("no opaque install-time code declared"),
            F.when(setup, F.to_json(count("n_setup_py"))).otherwise(bare),
        ),
    }
    names = ("status", "reason", "detail")
    gates |= {g.name: (g.status, g.reason, bare) for g in more}
    every = [*GATES, *((g.name, g.is_blocking) for g in more)]
    return [F.struct(F.lit(g).alias("gate_name"), F.lit(b).alias("is_blocking"), *(c.alias(n) for n, c in zip(names, gates[g]))) for g, b in every]


def gate_results(facts: DataFrame, more=()) -> DataFrame:
    """version_id, gate_name, is_blocking, status, reason, detail in long form."""
    return facts.select("version_id", F.explode(F.array(*gate_columns(more))).alias("g")).select("version_id", "g.*")


def valid_acceptances(acceptance: DataFrame) -> DataFrame:
    """Acceptances with a non-empty actor and reason."""
    return acceptance.where((F.trim("accepted_by") != "") & (F.trim("reason") != ""))


def accepted_gates(acceptance: DataFrame) -> DataFrame:
    """version_id and the set of its validly accepted gates."""
    return valid_acceptances(acceptance).groupBy("version_id").agg(F.collect_set("gate_name").alias("accepted"))


def verdict(gates: Column, accepted: Column) -> dict[str, Column]:
    """allowed, blocking and warnings (sorted names) of an array of gate structs (null: no row): unaccepted blocking failures,
    gates that weren't evaluated and registered gates without a row block; without any row nothing is listed."""
    empty = F.array().cast("array<string>")
    gates_, accepted = F.coalesce(gates, F.array()), F.coalesce(accepted, empty)
    named = lambda on: F.transform(F.filter(gates_, on), lambda g: g["gate_name"])
    failed = named(lambda g: ((g["status"] == "fail") & g["is_blocking"] & ~F.array_contains(accepted, g["gate_name"])) | (g["status"] == "not_evaluated"))
    missing = F.array_except(F.array(*(F.lit(g) for g, _ in GATES)), F.transform(gates_, lambda g: g["gate_name"]))
    blocking = F.when(F.size(gates_) == 0, empty).otherwise(F.array_sort(F.array_union(failed, missing)))
    return {"allowed": (F.size(gates_) > 0) & (F.size(blocking) == 0), "blocking": blocking, "warnings": F.array_sort(F.array_distinct(named(lambda g: g["status"] == "warn")))}


def publication(versions: DataFrame, results: DataFrame, acceptance: DataFrame) -> DataFrame:
    """version_id, allowed, blocking and warnings from stored gate rows, a few for each version."""
    rows = results.groupBy("version_id").agg(F.collect_list(F.struct("gate_name", "status", "is_blocking")).alias("gates"))
    out = versions.select("version_id").join(rows, "version_id", "left").join(accepted_gates(acceptance), "version_id", "left")
    return out.select("version_id", *(c.alias(n) for n, c in verdict(F.col("gates"), F.col("accepted")).items()))


def decided(facts: DataFrame, acceptance: DataFrame, more=()) -> DataFrame:
    """facts with allowed, blocking and warnings, the gates, and more of plug-ins, folded within the row."""
    rows = facts.join(accepted_gates(acceptance), "version_id", "left")
    return rows.withColumns(verdict(F.array(*gate_columns(more)), F.col("accepted"))).drop("accepted")


def guard_row(decided: DataFrame, revision: DataFrame, confidence: Column) -> DataFrame:
    """version_id and a boolean for each of the seven guards (true: passed), from decided facts with a summary."""
    newest = revision.where("snapshot_status = 'snapshotted'").groupBy("asset_id").agg(F.max("identified_at").alias("newest"))
    few = newest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else all versions would move to a few assets
    out = decided.join(F.broadcast(newest) if few else newest, "asset_id", "left")
    passed = {
        "current_revision": ~F.coalesce(F.col("newest") > F.col("bound_at"), F.lit(False)),
        "required_scorecard": confidence.isNotNull(),
        "confidence_threshold": F.coalesce(confidence, F.lit(0)) >= CONFIDENCE_THRESHOLD,
        "no_blocking_gate": F.coalesce("allowed", F.lit(False)),
        "source_binding": F.col("bound_at").isNotNull(),
        "summary": F.coalesce(F.trim("summary") != "", F.lit(False)),
        "interfaces": F.coalesce(F.col("n_interfaces") > 0, F.lit(False)),
    }
    return out.select("version_id", *(passed[g].alias(g) for g in GUARDS))


def guard_failures(guards: DataFrame) -> DataFrame:
    """version_id, n_failed and failed: names of failed guards in the order of GUARDS."""
    failed = F.array_compact(F.array(*(F.when(~F.col(g), F.lit(g)) for g in GUARDS)))
    return guards.select("version_id", failed.alias("failed")).withColumn("n_failed", F.size("failed"))


def transition_outcomes(requests: DataFrame, guards: DataFrame) -> DataFrame:
    """requests (version_id, from_state, target) with outcome noop, illegal, refused or advanced."""
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    step = F.concat_ws(">", "from_state", "target")
    out = requests.join(guard_failures(guards).select("version_id", "n_failed"), "version_id", "left")
    outcome = (
        F.when(F.col("from_state") == F.col("target"), "noop")
        .when(~F.array_contains(legal, step), "illegal")
        .when((F.col("target") == "cataloged") & (F.coalesce("n_failed", F.lit(1)) > 0), "refused")
        .otherwise("advanced")
    )
    return out.withColumn("outcome", outcome).drop("n_failed")


# ---- project constraints ----


def _listed(lower: bool = True) -> Column:
    return F.filter(F.split(F.coalesce(F.lower("listed") if lower else F.upper("listed"), F.lit("")), ","), lambda x: x != "")


def constraint_checks() -> dict[str, Column]:
    """A reason for each kind of constraint; the reasons in PASSING pass. cpu_only reports its kind as no_gpu."""
    topics = F.split(F.coalesce(F.lower("topics"), F.lit("")), ",")
    has = lambda names: F.arrays_overlap(topics, F.array(*map(F.lit, names)))
    runtime = F.lower(F.coalesce("runtime", F.lit("")))
    remote = runtime.isin(*REMOTE_RUNTIMES)
    tier = F.lower(F.coalesce("cost_tier", F.lit("")))
    no_license = F.coalesce("license_spdx", F.lit("")) == ""
    on_list = F.array_contains(_listed(), F.lower("license_spdx"))
    gpu = F.when(F.coalesce("requires_gpu", F.lit(False)), "gpu_required").when(has(GPU_HINTS), "gpu_topic").otherwise("ok")
    return {
        "cpu_only": gpu,
        "no_gpu": gpu,
        "must_be_free_tier": F.when(tier.isin("paid", "cheap_paid"), "paid").when(tier.isin("", "unknown"), "unknown_cost").otherwise("ok"),
        "must_be_local": F.when(remote, "remote_runtime").otherwise("ok"),
        "always_off_at_night": F.when(remote, "remote_runtime").when(has(BROKER_TOPICS), "requires_broker").otherwise("ok"),
        "budget_monthly_ceiling": F.when(F.col("amount_usd").isNull(), "no_ceiling").when(F.col("monthly_cost_usd").isNull(), "unknown_cost").when(F.col("monthly_cost_usd") > F.col("amount_usd"), "over_budget").otherwise("ok"),
        "license_allowlist": F.when(no_license, "unknown_license").when(~on_list, "license_not_allowed").otherwise("ok"),
        "license_denylist": F.when(no_license, "unknown_license").when(on_list, "license_denied").otherwise("ok"),
        "runtime_allowlist": F.when(runtime == "", "unknown_runtime").when(~F.array_contains(_listed(), runtime), "runtime_not_allowed").otherwise("ok"),
        "component_kind_allowlist": F.when(~F.array_contains(_listed(), F.lower("component_kind")), "kind_not_allowed").otherwise("ok"),
    }


PASSING = ("ok", "unknown_cost", "no_ceiling", "unknown_license", "unknown_runtime", "unknown_constraint_kind")


def constraint_details() -> dict[str, Column]:
    """What a reason rests on, by reason; a reason that isn't listed has an empty detail."""
    topics = F.split(F.coalesce(F.lower("topics"), F.lit("")), ",")
    hits = lambda names: F.array_join(F.array_sort(F.array_distinct(F.array_intersect(topics, F.array(*map(F.lit, names))))), ",")
    said = lambda *parts: F.concat(*(F.lit(x[1:]) if x[0] == "'" else F.coalesce(F.col(x).cast("string"), F.lit("")) for x in parts))
    return {
        "gpu_required": F.lit("requires_gpu is set"), "gpu_topic": F.concat(F.lit("topics "), hits(GPU_HINTS)), "requires_broker": F.concat(F.lit("topics "), hits(BROKER_TOPICS)),
        "paid": said("'cost_tier=", "cost_tier"), "remote_runtime": said("'runtime=", "runtime"), "over_budget": said("'$", "monthly_cost_usd", "' > $", "amount_usd"),
        "license_not_allowed": said("license_spdx", "' not in allowlist"), "license_denied": said("license_spdx", "' on denylist"), "unknown_license": F.lit("license_spdx missing"),
        "runtime_not_allowed": said("runtime", "' not in allowlist"), "unknown_runtime": F.lit("runtime missing"), "kind_not_allowed": said("component_kind", "' not in allowlist"),
        "unknown_cost": F.when(F.col("kind") == "must_be_free_tier", "cost_tier missing").otherwise("monthly_cost_usd missing"),
    }


#: Rows of configuration up to which project constraints are broadcast.
BROADCAST_ROWS = 100_000


def constraint_verdicts(capability: DataFrame, constraints: DataFrame) -> DataFrame:
    """capability_id, project_id, kind, passed, reason, detail of every component against every constraint of each project.

    Constraints are configuration; they are broadcast as far as their number is below a bound, beyond which the planner
    takes a cartesian product."""
    reason = F.lit("unknown_constraint_kind")
    for kind, check in constraint_checks().items():
        reason = F.when(F.col("kind") == kind, check).otherwise(reason)
    small = constraints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = capability.drop("kind").withColumnRenamed("id", "capability_id").join(F.broadcast(constraints) if small else constraints, F.lit(True))
    kind = F.when(F.col("kind") == "cpu_only", "no_gpu").otherwise(F.col("kind"))
    rows, detail = rows.withColumn("reason", reason), F.lit("")
    for name, text in constraint_details().items():
        detail = F.when(F.col("reason") == name, text).otherwise(detail)
    return rows.select("capability_id", "project_id", kind.alias("kind"), F.col("reason").isin(*PASSING).alias("passed"), "reason", detail.alias("detail"))


def constraint_fit(verdicts: DataFrame) -> DataFrame:
    """capability_id, project_id, hard_fail and the reasons of failed constraints."""
    return verdicts.groupBy("capability_id", "project_id").agg(
        (~F.bool_and("passed")).alias("hard_fail"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("reason")))), ",").alias("failed")
    )


# ---- compatibility ----

#: Runtimes that call each other directly; the relation is directed.
NATIVE = {
    "python_import": ("python_import",),
    "npm_import": ("npm_import",),
    "cargo_import": ("cargo_import",),
    "go_import": ("go_import",),
    "mcp_stdio": ("mcp_stdio", "mcp_sse", "mcp_http"),
    "mcp_sse": ("mcp_stdio", "mcp_sse", "mcp_http"),
    "mcp_http": ("mcp_stdio", "mcp_sse", "mcp_http"),
    "claude_skill": ("claude_skill", "claude_agent"),
    "claude_agent": ("claude_skill", "claude_agent"),
    "cli_subprocess": ("cli_subprocess",),
    "git_clone": ("git_clone",),
    "http_endpoint": ("http_endpoint", "mcp_http", "mcp_sse"),
    "other": (),
}
#: Pairs that an adapter bridges.
BRIDGES = (
    ("python_import", "cli_subprocess"), ("cli_subprocess", "python_import"), ("python_import", "http_endpoint"), ("http_endpoint", "python_import"),
    ("npm_import", "http_endpoint"), ("http_endpoint", "npm_import"), ("python_import", "mcp_stdio"), ("mcp_stdio", "python_import"),
    ("cli_subprocess", "http_endpoint"), ("http_endpoint", "cli_subprocess"), ("git_clone", "python_import"), ("git_clone", "cli_subprocess"),
    ("claude_skill", "mcp_stdio"), ("claude_agent", "mcp_stdio"), ("claude_skill", "python_import"), ("claude_agent", "python_import"),
)


#: What a bridge is made of; other bridges have GENERIC_HINT.
BRIDGE_HINTS = {
    ("python_import", "cli_subprocess"): "subprocess.run() call, capture stdout",
    ("cli_subprocess", "python_import"): "subprocess.run() call, capture stdout",
    ("python_import", "http_endpoint"): "httpx.Client call",
    ("http_endpoint", "python_import"): "httpx.Client call",
    ("npm_import", "http_endpoint"): "fetch() call",
    ("http_endpoint", "npm_import"): "fetch() call",
    ("python_import", "mcp_stdio"): "mcp.ClientSession + stdio_client",
    ("mcp_stdio", "python_import"): "mcp.ClientSession + stdio_client",
    ("git_clone", "python_import"): "pip install -e . after clone",
    ("git_clone", "cli_subprocess"): "clone then run the CLI binary from the tree",
    ("claude_skill", "mcp_stdio"): "skill invokes the MCP tool by name",
    ("claude_agent", "mcp_stdio"): "agent calls the tool via its MCP client",
}
GENERIC_HINT, UNKNOWN_HINT, CLASH_HINT = "generic glue script", "one side has no declared runtime; assume glue", "write a type transformer"


def runtime_matrix(spark) -> DataFrame:
    """src, tgt, class (native or bridge) and a bridge's hint: a few dozen rows of configuration."""
    rows = [(a, b, "native", None) for a, bs in NATIVE.items() for b in bs] + [(a, b, "bridge", BRIDGE_HINTS.get((a, b), GENERIC_HINT)) for a, b in BRIDGES]
    return spark.createDataFrame(rows, "src_runtime string, tgt_runtime string, class string, hint string")


def io_check(src: Column, tgt: Column) -> Column:
    """match, mismatch or unknown_io of two struct<kind, type, of> columns."""
    low = lambda c, f: F.lower(F.coalesce(c[f], F.lit("")))
    unknown = src.isNull() | tgt.isNull() | (low(src, "kind") == "") | (low(tgt, "kind") == "")
    differ = low(src, "kind") != low(tgt, "kind")
    for f in ("type", "of"):
        differ = differ | ((low(src, f) != "") & (low(tgt, f) != "") & (low(src, f) != low(tgt, f)))
    return F.when(unknown, "unknown_io").when(differ, "mismatch").otherwise("match")


def compatibility(pairs: DataFrame) -> DataFrame:
    """pairs (src_runtime, tgt_runtime, src_output, tgt_input) with verdict, reason, io_type_check, detail and adapter_hint."""
    matrix = F.broadcast(runtime_matrix(pairs.sparkSession))  # fixed size
    rows = pairs.withColumn("src_runtime", F.lower("src_runtime")).withColumn("tgt_runtime", F.lower("tgt_runtime")).join(matrix, ["src_runtime", "tgt_runtime"], "left")
    rows = rows.withColumn("io_type_check", io_check(F.col("src_output"), F.col("tgt_input")))
    unknown = F.col("src_runtime").isNull() | F.col("tgt_runtime").isNull()
    clash = (F.col("class") == "native") & (F.col("io_type_check") == "mismatch")
    verdict = F.when(unknown | clash | (F.col("class") == "bridge"), "adapter_needed").when(F.col("class") == "native", "compatible").otherwise("incompatible")
    reason = (
        F.when(unknown, "unknown_runtime").when(clash, "io_mismatch_within_family").when(F.col("class") == "native", "same_family")
        .when(F.col("class") == "bridge", "bridge_available").otherwise("no_known_bridge")
    )
    hint = F.when(unknown, UNKNOWN_HINT).when(clash, CLASH_HINT).when(F.col("class") == "bridge", F.col("hint")).otherwise("")
    src, tgt = (F.coalesce(c, F.lit("")) for c in ("src_runtime", "tgt_runtime"))
    detail = F.when(clash, F.concat(src, F.lit(" <-> "), tgt, F.lit(" runtime-compatible but I/O types differ"))).otherwise(F.concat(src, F.lit(" -> "), tgt))
    return rows.withColumns({"verdict": verdict, "reason": reason, "adapter_hint": hint, "detail": detail}).drop("class", "hint")
