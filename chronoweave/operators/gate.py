"""Artifacts checked by type in one pass, and a gate that lets a write appear only if what was counted in that pass allows it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROI = "('full', 'partial', 'not_visible')"
FORBIDDEN = ("score", "predicted_score", "automated_decision", "predicted_decision", "final_decision", "final_rubric_decision", "rubric_decision")


def get(path: str, kind: str = "string", of: str = "root") -> str:
    return f"try_variant_get({of}, '$.{path}', '{kind}')"


def absent(*paths: str, of: str = "root") -> str:
    """Any of these fields is missing or null."""
    return " or ".join(f"{get(p, 'variant', of)} is null or is_variant_null({get(p, 'variant', of)})" for p in paths)


def true(path: str, of: str = "root") -> str:
    """The field is a boolean and true; what could be read as one doesn't count."""
    return f"({shape(path, of)} = 'BOOLEAN' and {get(path, 'boolean', of)})"


def shape(path: str, of: str = "root") -> str:
    return f"coalesce(schema_of_variant({get(path, 'variant', of)}), 'VOID')"


def listed(path: str, of: str = "root") -> str:
    return f"coalesce({get(path, 'array<variant>', of)}, array())"


def some(path: str, rule: str, of: str = "root") -> str:
    return f"exists({listed(path, of)}, x -> {rule})"


RECORD = "schema_of_variant(x) like 'OBJECT%'"
NOT_LIST = lambda path: f"{shape(path)} not like 'ARRAY%'"
DECIDED = f"{get('automated_decision')}"
SCORE = f"coalesce({get('predicted_score', 'double')}, {get('score', 'double')})"
PACKAGE = {
    "MISSING_REQUIRED_FIELD": absent("rubric_id", "source_video", "automated_decision", "automated_outcome"),
    "INVALID_DECISION": f"coalesce({DECIDED} not in ('yes', 'no', 'abstained'), true)",
    "INVALID_AUTOMATED_OUTCOME": f"coalesce({get('automated_outcome')} not in ('scored', 'abstained'), true)",
    "ABSTAINED_WITH_SCORE": f"{DECIDED} = 'abstained' and {SCORE} is not null",
    "ABSTENTION_REASON_MISSING": f"{get('automated_outcome')} = 'abstained' and coalesce(trim({get('abstention_reason')}), '') = ''",
    "SCORED_OUTCOME_INVALID_SCORE": f"{get('automated_outcome')} = 'scored' and coalesce({SCORE} not in (0, 1), true)",
    "DECISION_OUTCOME_MISMATCH": f"coalesce(({DECIDED} = 'abstained') <> ({get('automated_outcome')} = 'abstained'), false)",
}
#: type -> code -> SQL over `root` (a VARIANT object) that holds where the rule is broken.
RULES: dict[str, dict[str, str]] = {
    "frame_manifest": {
        "MISSING_REQUIRED_FIELD": f"{absent('source_video', 'frames')} or {some('frames', RECORD + ' and (' + absent('timestamp_seconds', of='x') + ')')}",
        "INVALID_FRAMES": NOT_LIST("frames"),
        "INVALID_FRAME_RECORD": some("frames", f"not ({RECORD})"),
        "MISSING_FRAME_OUTPUT_PATH": some("frames", f"{RECORD} and {get('output_path', 'variant', 'x')} is null and {get('frame_path', 'variant', 'x')} is null"),
    },
    "evidence_availability_review": {
        "MISSING_REQUIRED_FIELD": f"{absent('rubric_id', 'source_video', 'candidate_reviews', 'review_method')} or {some('candidate_reviews', RECORD + ' and (' + absent('timestamp_seconds', 'frame_path', 'usable_for_qwen_evidence', of='x') + ')')}",
        "INVALID_CANDIDATE_REVIEWS": NOT_LIST("candidate_reviews"),
        "INVALID_CANDIDATE_REVIEW": some("candidate_reviews", f"not ({RECORD})"),
        "INVALID_ROI_STATUS": some("candidate_reviews", " or ".join(f"({get(f, 'variant', 'x')} is not null and coalesce({get(f, of='x')} not in {ROI}, true))" for f in ("switch_visibility", "voltmeter_visibility", "ammeter_visibility"))),
    },
    "dynamic_roi_results": {
        "MISSING_REQUIRED_FIELD": absent("frames"),
        "INVALID_FRAMES": NOT_LIST("frames"),
        "MISSING_DEVICE_RESULT": some("frames", " or ".join(f"{shape(f'devices.{d}', 'x')} not like 'OBJECT%'" for d in ("voltmeter", "ammeter", "switch"))),
        "INVALID_ROI_STATUS": some("frames", " or ".join(f"({shape(f'devices.{d}', 'x')} like 'OBJECT%' and coalesce({get(f'devices.{d}.status', of='x')} not in {ROI}, true))" for d in ("voltmeter", "ammeter", "switch"))),
        "CROP_PRESENT_FOR_NOT_VISIBLE": some("frames", " or ".join(f"coalesce({get(f'devices.{d}.status', of='x')} = 'not_visible' and {get(f'devices.{d}.{c}_crop', of='x')} is not null, false)" for d in ("voltmeter", "ammeter", "switch") for c in ("original", "enhanced"))),
        "MISSING_OR_INVALID_BBOX": some("frames", " or ".join(f"coalesce({get(f'devices.{d}.status', of='x')} in ('full', 'partial') and coalesce(size(filter({get(f'devices.{d}.bbox', 'array<double>', 'x')}, b -> b is not null)) <> 4, true), false)" for d in ("voltmeter", "ammeter", "switch"))),
    },
    "qwen_structured_result": {
        "INVALID_JSON_PARSED": f"{shape('json_parsed')} <> 'BOOLEAN'",
        "INVALID_SAFETY_VALID": f"{shape('safety_valid')} <> 'BOOLEAN'",
        "MISSING_STRUCTURED_RESULT": f"{true('json_parsed')} and {shape('structured_result')} not like 'OBJECT%' and {shape('result')} not like 'OBJECT%'",
        "SAFETY_VALID_WITH_ERRORS": f"{true('safety_valid')} and ({NOT_LIST('validation_errors')} or size({listed('validation_errors')}) > 0)",
        "FORBIDDEN_QWEN_SCORING_FIELD": " or ".join(f"{get(f'structured_result.{f}', 'variant')} is not null" for f in FORBIDDEN),
    },
    "evidence_package": PACKAGE,
    "prediction_package": {**PACKAGE, "MISSING_CIRCUIT_EVIDENCE": f"{shape('circuit_closed_evidence')} not like 'OBJECT%'"},
    "offline_evaluation": {
        "MISSING_REQUIRED_FIELD": absent("prediction_package_path", "prediction_package_sha256"),
        "INVALID_PREDICTION_SHA256": f"coalesce(not {get('prediction_package_sha256')} rlike '^[0-9a-fA-F]{{64}}$', true)",
        "PREDICTION_NOT_FROZEN_BEFORE_GROUND_TRUTH": f"not {true('prediction_frozen_before_ground_truth')}",
    },
    "validation_gate": {
        "MISSING_REQUIRED_FIELD": absent("rubric_id", "status", "frozen_artifacts", "required_new_data", "prohibited_actions"),
        "MISSING_BLOCKED_GATE_REQUIREMENT": f"{get('status')} = 'blocked_waiting_for_data' and (" + " or ".join(f"size({listed(f)}) = 0" for f in ("required_new_data", "prohibited_actions", "frozen_artifacts")) + ")",
        "INVALID_FROZEN_ARTIFACT": f"{get('status')} = 'blocked_waiting_for_data' and {some('frozen_artifacts', absent('path', 'sha256', of='x'))}",
        "INVALID_FROZEN_ARTIFACT_SHA256": f"{get('status')} = 'blocked_waiting_for_data' and {some('frozen_artifacts', 'coalesce(not ' + get('sha256', of='x') + ' rlike ' + repr('^[0-9a-fA-F]{64}$') + ', false)')}",
    },
}
CODES = ("JSON_PARSE_ERROR", "INVALID_ROOT_TYPE", "UNKNOWN_ARTIFACT_TYPE", *dict.fromkeys(c for rules in RULES.values() for c in rules))


def checked_artifacts(rows: DataFrame, kind: str, body: str) -> DataFrame:
    """rows with `errors`, the codes of all rules that an artifact (JSON text) of its type breaks, in the order of CODES.

    What isn't JSON, has no object as its root (a leading byte-order mark is ignored) or is of no known type breaks that one rule
    alone. Only the rules of a row's type are looked at, once each, and its text is parsed once.
    """
    text = F.regexp_replace(F.coalesce(body, F.lit("")), "^﻿", "")
    # a generated column is computed once a row: as a projected one it would be put in the place of each of its uses in a filter
    rows = rows.withColumn("root", F.explode(F.array(F.try_parse_json(text))))
    alone = lambda code: F.array(F.lit(code))
    found = F.when(F.col("root").isNull(), alone("JSON_PARSE_ERROR")).when(F.expr("schema_of_variant(root) not like 'OBJECT%'"), alone("INVALID_ROOT_TYPE"))
    for t, rules in RULES.items():
        broken = [F.when(F.coalesce(F.expr(rules[code]), F.lit(False)), F.lit(code)) for code in CODES if code in rules]
        found = found.when(F.col(kind) == t, F.array_compact(F.array(*broken)))
    rows = rows.withColumn("errors", F.explode(F.array(found.otherwise(alone("UNKNOWN_ARTIFACT_TYPE")))))
    return rows.drop("root")


def gated_write(rows: DataFrame, path: str, name: str, *, errors: str = "errors", most: float = 0.0) -> tuple[bool, dict[str, int]]:
    """Write rows as Parquet under path/name, to be seen only if at most a share `most` of them has errors; and the counts that say so.

    Rows, rows with errors and rows of each code are observed while the rows are written to a hidden folder, so that there is
    one pass; then the folder is renamed, or removed. A name that is taken is an error before anything is written.
    """
    spark: SparkSession = rows.sparkSession
    target, staged = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (name, f".{name}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target):
        raise FileExistsError(f"{path}/{name} exists")
    seen = Observation()
    by_code = [F.count_if(F.array_contains(errors, c)).alias(c) for c in CODES]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(errors) > 0).alias("wrong"), *by_code).write.parquet(staged.toString())
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    opened = counts["wrong"] <= most * counts["rows"]
    if opened:
        if not fs.rename(staged, target):
            raise FileExistsError(f"{path}/{name} can't be put in place")
    else:
        fs.delete(staged, True)
    return opened, counts
