"""The registry of sources: TOML in, typed rows and errors out."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
REQUIRED = ("source_id", "display_name", "organization", "adapter")
OPTIONAL = {
    "landing_url": None, "endpoint_config": {}, "categories": [], "tags": [], "cadence_hours": 24, "enabled": True, "official_source": False, "rate_limit_min_seconds": 0.0, "last_validated": None,
    "validation_status": "pending", "provenance_note": None, "quarantine_reason": None,
}
SCHEMA = (
    "source_id string, display_name string, organization string, adapter string, landing_url string, config string, categories array<string>, tags array<string>, cadence_hours int, enabled boolean, official boolean, "
    "rate_limit_min_seconds double, last_validated string, validation_state string, provenance_note string, quarantine_reason string"
)


def parse(text: str, adapters: Sequence[str]) -> tuple[list[tuple], list[str]]:
    """(rows, errors); entries with missing keys or a repeated id are left out, the others stay with their errors."""
    entries, rows, errors, seen = tomllib.loads(text).get("sources", []), [], [], set()
    if not isinstance(entries, list):
        return [], ["'sources' must be an array of tables"]
    for i, e in enumerate(entries):
        errors += [f"sources[{i}]: unknown key '{k}'" for k in sorted(set(e) - set(REQUIRED) - set(OPTIONAL))]
        if missing := sorted(set(REQUIRED) - set(e)):
            errors.append(f"sources[{i}]: missing required keys {missing}")
            continue
        if e["source_id"] in seen:
            errors.append(f"duplicate source_id: {e['source_id']}")
            continue
        seen.add(e["source_id"])
        v = {**OPTIONAL, **e}
        if v["adapter"] not in adapters and not v["quarantine_reason"]:
            errors.append(f"{v['source_id']}: unknown adapter '{v['adapter']}'")
        if not isinstance(v["cadence_hours"], int) or v["cadence_hours"] < 1:
            errors.append(f"{v['source_id']}: cadence_hours must be a whole number from 1")
        rows.append(
            (v["source_id"], v["display_name"], v["organization"], v["adapter"], v["landing_url"], json.dumps(v["endpoint_config"], sort_keys=True), list(v["categories"]), list(v["tags"]), int(v["cadence_hours"]), bool(v["enabled"]),
             bool(v["official_source"]), float(v["rate_limit_min_seconds"]), v["last_validated"], v["validation_status"], v["provenance_note"], v["quarantine_reason"])
        )
    return rows, errors


def read(spark: SparkSession, text: str, adapters: Sequence[str]) -> tuple[DataFrame, list[str]]:
    rows, errors = parse(text, adapters)
    return spark.createDataFrame(rows, SCHEMA), errors


def validation(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, validation_state): what a probe says of each source."""
    state = (
        F.when(F.col("quarantine_reason").isNotNull(), "quarantined").when(~F.col("ok"), "failed").when(F.col("records") > 0, "validated").when(F.col("state") == "valid-empty", "validated-empty-ok").otherwise("failed")
    )
    return sources.select("source_id", "quarantine_reason").join(checks, "source_id").select("source_id", state.alias("validation_state"))
