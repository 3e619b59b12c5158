"""Validation of request bodies, a projection for each command: ok, or the error of the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.schema import MAX_BODY_BYTES, MAX_ID_BYTES, MAX_ONESHOT_MEMORIES, MAX_TEXT_BYTES

# The fields of each command.
FIELDS = {
    "create-session": ("kv_persist", "kv-persist"), "add-system": ("text",), "add-memory": ("id", "text"), "search": ("query", "query_context", "top_k"),
    "oneshot-search": ("system", "memories", "query", "query_context", "top_k"),
}


def _kind(body: Column, field: str) -> Column:
    """The JSON type of a field: STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY..., OBJECT..., VOID (null), or null if absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$['{field}']", "variant"))


def coerced_int(body: Column, field: str) -> Column:
    """A field as an integer: a number without fraction, or a text of one; null for anything else, booleans too."""
    kind, told = _kind(body, field), F.try_variant_get(F.try_parse_json(body), f"$['{field}']", "string")
    whole = (kind == "BIGINT") | ((kind == "STRING") & told.rlike(r"\A\s*[+-]?[0-9]+\s*\z"))
    return F.when(whole, F.btrim(told).try_cast("bigint"))


def _has(body: Column, field: str) -> Column:
    return F.array_contains(F.json_object_keys(body), field)


def _string(body: Column, field: str, most: int, required: bool) -> list[tuple[Column, str, Column]]:
    kind, value = _kind(body, field), F.try_variant_get(F.try_parse_json(body), f"$['{field}']", "string")
    rules = [(_has(body, field) & (kind != "STRING") & ~((kind == "VOID") & F.lit(not required)), "must be a string", F.lit(field)), (F.octet_length(value) > most, "exceeds maximum length", F.lit(field))]
    return [(~_has(body, field), "requires", F.lit(field)), *rules] if required else rules


def _top_k(body: Column) -> list[tuple[Column, str, Column]]:
    kind, value = _kind(body, "top_k"), F.try_variant_get(F.try_parse_json(body), "$['top_k']", "bigint")
    return [(_has(body, "top_k") & (kind != "VOID") & ((kind != "BIGINT") | ~value.between(0, 2**31 - 1)), "must be a non-negative integer", F.lit("top_k"))]


def _rules(command: str, body: Column) -> list[tuple[Column, str, Column]]:
    unknown = F.try_element_at(F.array_except(F.json_object_keys(body), F.array(*map(F.lit, FIELDS[command]))), F.lit(1))
    rules = [(unknown.isNotNull(), "contains unknown field", unknown)]
    if command == "create-session":
        rules.append((_has(body, "kv_persist") & _has(body, "kv-persist"), "must be given once", F.lit("kv_persist")))
        rules += [(_has(body, f) & ~_kind(body, f).isin("BOOLEAN", "VOID"), "must be a boolean", F.lit(f)) for f in FIELDS[command]]
    elif command == "add-system":
        rules += _string(body, "text", MAX_TEXT_BYTES, True)
    elif command == "add-memory":
        rules += _string(body, "text", MAX_TEXT_BYTES, True) + _string(body, "id", MAX_ID_BYTES, False)
    else:
        rules += _string(body, "query", MAX_TEXT_BYTES, True) + _string(body, "query_context", MAX_TEXT_BYTES, False) + _top_k(body)
    if command == "oneshot-search":
        rules += _string(body, "system", MAX_TEXT_BYTES, False)
        entry = F.from_json(F.get_json_object(body, "$.memories"), "array<string>")

        def bad(m: Column) -> Column:
            """A memory is an object of a text and perhaps an id, both of the kinds and lengths that add-memory takes."""
            told = lambda f: F.try_variant_get(F.try_parse_json(m), f"$['{f}']", "string")
            strange = (F.size(F.array_except(F.json_object_keys(m), F.array(F.lit("id"), F.lit("text")))) > 0) | ~_has(m, "text")
            text = (_kind(m, "text") != "STRING") | (F.octet_length(told("text")) > MAX_TEXT_BYTES)
            name = _has(m, "id") & (~_kind(m, "id").isin("STRING", "VOID") | F.coalesce(F.octet_length(told("id")) > MAX_ID_BYTES, F.lit(False)))
            return F.json_object_keys(m).isNull() | strange | text | name

        first = F.array_position(F.transform(entry, lambda m: F.coalesce(bad(m), F.lit(True))), F.lit(True))
        rules += [
            (~F.coalesce(F.startswith(_kind(body, "memories"), F.lit("ARRAY")), F.lit(False)), "must be an array", F.lit("memories")), (F.size(entry) == 0, "requires a memory", F.lit("memories")),
            (F.size(entry) > MAX_ONESHOT_MEMORIES, "exceeds maximum length", F.lit("memories")), (first > 0, "must be a memory", F.concat(F.lit("memories["), (first - 1).cast("string"), F.lit("]"))),
        ]
    return rules


def validated(requests: DataFrame, command: str, body: str = "body") -> DataFrame:
    """Adds ok, code and field (of the first offence) to requests."""
    b = F.col(body)
    rules = [(F.coalesce(b, F.lit("")) == "", "must be a JSON object", F.lit("body")), (F.octet_length(b) > MAX_BODY_BYTES, "payload too large", F.lit("body"))]
    rules += [(F.json_object_keys(b).isNull(), "must be a JSON object", F.lit("body")), *_rules(command, b)]
    message, field = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, said, where in reversed(rules):
        hit = F.coalesce(test, F.lit(False))
        message, field = F.when(hit, F.lit(said)).otherwise(message), F.when(hit, where).otherwise(field)
    code = F.when(message == "payload too large", "PAYLOAD_TOO_LARGE").when(message.isNotNull(), "INVALID_REQUEST")
    return requests.withColumn("message", message).withColumn("ok", F.col("message").isNull()).withColumn("code", code).withColumn("field", field)


def responses(results: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, body): {"data": [...]} with a row for each result in order of rank; null fields are left out."""
    rows = results.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"]))).alias("data"))
    return rows.select(*by, F.to_json(F.struct("data")).alias("body"))


def error_responses(errors: DataFrame) -> DataFrame:
    """(status, body): {"error": {code, message, details}} of error messages."""
    from memlattice.functions.text import error_code, error_details, http_status

    e = F.struct(error_code(F.col("message")).alias("code"), F.col("message").alias("message"), error_details(F.col("message")).alias("details"))
    return errors.select(http_status(error_code(F.col("message"))).alias("status"), F.to_json(F.struct(e.alias("error"))).alias("body"))
