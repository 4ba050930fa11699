"""Stored documents as frames: results, diagnostics, constraints, detector settings and checkpoints of known versions, with the fields they have
beyond the known ones kept.

A document is a VARIANT, so that a field of a later version needs no schema: known fields come out typed, the others stay in
`unknown` and go back into what is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that can be read, and the one that is written.
VERSIONS, CURRENT = (1, 2), 1

# The known fields of each kind of document.
_DIAGNOSTICS = {
    "n": "bigint", "d": "bigint", "schema_version": "int", "engine_version": "string", "runtime_ms": "bigint", "notes": "array<string>", "warnings": "array<string>",
    "algorithm": "string", "cost_model": "string", "seed": "bigint", "repro_mode": "string", "thread_count": "bigint", "blas_backend": "string", "cpu_features": "array<string>",
    "params_json": "variant", "pruning_stats": "struct<candidates_considered:bigint,candidates_pruned:bigint>", "missing_policy_applied": "string", "missing_fraction": "double",
    "effective_sample_count": "bigint",
}
_CONSTRAINTS = {
    "schema_version": "int", "min_segment_len": "bigint", "max_change_points": "bigint", "max_depth": "bigint", "candidate_splits": "array<bigint>", "jump": "bigint",
    "time_budget_ms": "bigint", "max_cost_evals": "bigint", "memory_budget_bytes": "bigint", "max_cache_bytes": "bigint", "cache_policy": "variant",
    "degradation_plan": "variant", "allow_algorithm_fallback": "boolean",
}
_RESULT = {
    "breakpoints": "array<bigint>", "change_points": "array<bigint>", "scores": "array<double>",
    "segments": "array<struct<start:bigint,end:bigint,mean:array<double>,variance:array<double>,count:bigint,missing_count:bigint>>", "diagnostics": "variant",
}
KINDS = {"result": _RESULT, "diagnostics": _DIAGNOSTICS, "constraints": _CONSTRAINTS}


def _field(document: Column, name: str, kind: str) -> Column:
    """A field of the document with its type; null where it is absent or a JSON null."""
    return F.variant_get(document, f"$.{name}", kind)


def _refused(ok: Column, value: Column, why: Column) -> Column:
    """value where ok holds; an error elsewhere."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(why))


def _checked(version: Column, value: Column, kind: str, known: tuple = VERSIONS) -> Column:
    why = F.concat(F.lit(f"{kind}: schema version "), F.coalesce(version.cast("string"), F.lit("(none)")), F.lit(f" is not supported; known are {known[0]} to {known[-1]}"))
    return _refused(version.isin(*known), value, why)


def _beyond(document: Column, known) -> Column:
    """The document's fields beyond the known ones, by name."""
    return F.map_filter(F.from_json(F.to_json(document), "map<string,variant>"), lambda k, _: ~k.isin(*known))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """document, one for each file, or for each line of the files."""
    text = spark.read.text(path, wholetext=not lines).where("trim(value) != ''")
    return text.select(F.parse_json("value").alias("document"))


def migrated(documents: DataFrame, kind: str) -> DataFrame:
    """The known fields of documents (column document), schema_version, and unknown, the other fields by name.

    kind: result, diagnostics or constraints. A result's version is that of its diagnostics, whose own unknown fields come in
    unknown_diagnostics. Breakpoints must rise and be there; change points are the breakpoints but the last.
    """
    d, fields = F.col("document"), KINDS[kind]
    place = "diagnostics.schema_version" if kind == "result" else "schema_version"
    version = _field(d, place, "int")
    own = documents.select(_checked(version, d, kind).alias("document"))
    columns = {name: _field(d, name, t) for name, t in fields.items() if name != "schema_version"}
    more = [_beyond(d, fields).alias("unknown")]
    if kind == "result":
        b = columns["breakpoints"]
        rising = F.forall(F.arrays_zip(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))).alias("a"), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))).alias("b")), lambda p: p["a"] < p["b"])
        columns["breakpoints"] = _refused((F.size(b) > 0) & rising, b, F.lit("breakpoints must be strictly increasing and not empty"))
        columns["change_points"] = F.slice(b, 1, F.size(b) - 1)
        more.append(_beyond(_field(d, "diagnostics", "variant"), _DIAGNOSTICS).alias("unknown_diagnostics"))
    return own.select(version.alias("schema_version"), *[c.alias(name) for name, c in columns.items()], *more)


def rewritten(documents: DataFrame, kind: str) -> DataFrame:
    """value, the documents as JSON in the version that is written; unknown fields stay where they were."""
    d, fields = F.col("document"), KINDS[kind]
    every = lambda c: F.from_json(F.to_json(c), "map<string,variant>")
    current = F.map_from_entries(F.array(F.struct(F.lit("schema_version").alias("key"), F.to_variant_object(F.struct(F.lit(CURRENT).alias("v"))).alias("value"))))
    as_current = lambda c: F.map_zip_with(every(c), current, lambda k, own, new: F.when(k == "schema_version", F.variant_get(new, "$.v", "variant")).otherwise(own))
    checked = documents.select(_checked(_field(d, "diagnostics.schema_version" if kind == "result" else "schema_version", "int"), d, kind).alias("document"))
    if kind != "result":
        return checked.select(F.to_json(as_current(d)).alias("value"))
    inner = F.parse_json(F.to_json(as_current(_field(d, "diagnostics", "variant"))))
    return checked.select(F.to_json(F.transform_values(every(d), lambda k, v: F.when(k == "diagnostics", inner).otherwise(v))).alias("value")) if "diagnostics" in fields else checked


def checkpoints(documents: DataFrame) -> DataFrame:
    """detector_id, state_schema_version, engine, created_at_ns, payload (the state as JSON), payload_crc32, intact and unknown.

    The first form (schema_version 0) holds the state as an object and the checksum of its JSON, keys in order, as hexadecimal
    digits; the present one holds the bytes of the state's JSON and the checksum as a number. intact: the checksum agrees.
    """
    d = F.col("document")
    version = F.coalesce(_field(d, "state_schema_version", "int"), _field(d, "schema_version", "int"))
    old = _field(d, "state_schema_version", "int").isNull()
    bytes_ = F.variant_get(d, "$.payload", "variant")
    digits = F.array_join(F.transform(F.try_variant_get(d, "$.payload", "array<int>"), lambda b: F.lpad(F.hex(b), 2, "0")), "")
    payload = F.when(old, F.to_json(bytes_)).otherwise(F.decode(F.unhex(digits), "UTF-8"))
    crc = F.when(old, F.conv(F.try_variant_get(d, "$.payload_crc32", "string"), 16, 10).cast("bigint")).otherwise(F.try_variant_get(d, "$.payload_crc32", "bigint"))
    known = ("detector_id", "schema_version", "state_schema_version", "engine_version", "engine_fingerprint", "created_at_ns", "payload_codec", "payload_crc32", "payload")
    codec = _refused(_field(d, "payload_codec", "string") == "json", d, F.concat(F.lit("checkpoint: payload codec "), F.coalesce(_field(d, "payload_codec", "string"), F.lit("(none)")), F.lit(" is not supported")))
    own = documents.select(_checked(version, codec, "checkpoint", (0, 1)).alias("document"))
    out = own.select(_field(d, "detector_id", "string").alias("detector_id"), version.alias("state_schema_version"), F.coalesce(_field(d, "engine_fingerprint", "string"), _field(d, "engine_version", "string")).alias("engine"), _field(d, "created_at_ns", "bigint").alias("created_at_ns"), payload.alias("payload"), crc.alias("payload_crc32"), _beyond(d, known).alias("unknown"))
    return out.withColumn("intact", F.crc32(F.col("payload").cast("binary")) == F.col("payload_crc32"))
