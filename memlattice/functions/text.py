"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("int")


def valid_session_id(x: Column) -> Column:
    """ASCII letters, digits and . _ -, but neither . nor .."""
    return F.coalesce(x.rlike(r"\A[A-Za-z0-9._-]+\z") & ~x.isin(".", ".."), F.lit(False))


def storage_component(x: Column) -> Column:
    """Each run of other characters becomes one _, those at the ends go; . and .. become empty."""
    safe = F.btrim(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.when(safe.isin(".", ".."), F.lit("")).otherwise(safe)


def dashed_session_id(x: Column) -> Column:
    """Each character other than letters, digits, . _ - becomes a dash."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}._-]", "-")


def dashed_repository(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "-")


def within_bytes(x: Column, most: int) -> Column:
    return F.octet_length(x) <= most


def media_type_is_json(x: Column) -> Column:
    """Parameters are ignored, case and outer blanks and tabs too; absent or empty is refused."""
    return F.coalesce(F.lower(F.btrim(F.substring_index(x, ";", 1), F.lit(" \t"))) == "application/json", F.lit(False))


def memory_text(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(": "), text)


def chunk_text(file: Column, first: Column, last: Column, text: Column) -> Column:
    return F.concat(F.lit("// "), file, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"), text)


def corpus_id(session: Column, turn: Column, has_answer: Column) -> Column:
    """session_turn, turn from 1; the label 'answer' is withdrawn from turns without the answer."""
    name = F.concat(session, F.lit("_"), turn.cast("string"))
    return F.when(F.contains(session, F.lit("answer")) & ~F.coalesce(has_answer, F.lit(False)), F.replace(name, F.lit("answer"), F.lit("noans"))).otherwise(name)


def header_id(session: Column) -> Column:
    return F.when(F.contains(session, F.lit("answer")), F.replace(F.concat(session, F.lit("_header")), F.lit("answer"), F.lit("noans"))).otherwise(F.concat(session, F.lit("_header")))


def squeezed(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def tagged_answer(x: Column, tag: str = "answer") -> Column:
    """The first <tag>...</tag>, in any case and across lines, trimmed; null without one."""
    found = F.regexp_extract(x, f"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.when(x.rlike(f"(?is)<{tag}>.*?</{tag}>"), F.regexp_replace(found, r"\A\s+|\s+\z", ""))


# How replies begin, and what they contain, that announce an answer instead of giving it.
PROCEDURAL_STARTS = (
    "now let me", "now i have", "let me ", "i need to ", "i should ", "i will ", "i'll ", "the background agent", "the agent is ", "i have all the evidence",
)
PROCEDURAL_PARTS = (
    "compose the final answer", "formulate the final answer", "write the final answer", "look at the ", "completed and confirms the analysis", "final answer i provided above",
)


def is_procedural(x: Column) -> Column:
    """Whether a reply only announces an answer: empty, or at most 800 characters with one of the phrases."""
    s = squeezed(x)
    starts = reduce(lambda a, b: a | b, [F.startswith(s, F.lit(p)) for p in PROCEDURAL_STARTS])
    parts = reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in PROCEDURAL_PARTS])
    return (s == "") | ((F.length(s) <= 800) & (starts | parts))


def size_bytes(x: Column) -> Column:
    """Bytes of a size such as 10k, 4GiB or 7; null if it isn't one or doesn't fit 64 bits. A number beyond 64 bits counts as their largest."""
    number = F.regexp_extract(x, r"(?i)\A\s*\+?0*([0-9]+)([kmgt]?i?b?)\z", 1)
    unit = F.lower(F.regexp_extract(x, r"(?i)\A\s*\+?([0-9]+)([kmgt]?i?b?)\z", 2))
    power = F.when(unit.isin("", "b"), 0).when(unit.isin("k", "kb", "kib"), 1).when(unit.isin("m", "mb", "mib"), 2).when(unit.isin("g", "gb", "gib"), 3).when(unit.isin("t", "tb", "tib"), 4)
    factor = F.element_at(F.array(*[F.lit(str(1024**i)).cast("decimal(20,0)") for i in range(5)]), power + 1)
    most = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    told = F.when(F.length(number) > 20, most).when(number != "", F.least(number.try_cast("decimal(20,0)"), most))
    value = told * factor
    return F.when(value <= most, value.cast("decimal(20,0)"))


def range_text(ranges: Column) -> Column:
    """array<struct<start,end>> as 3-7,9."""
    return F.array_join(F.transform(ranges, lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))), ",")


def abbreviated(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fk", n / 1_000)).otherwise(n.cast("string"))


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("unknown time"))


def url_segment(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def log_line(x: Column, most: int = 160) -> Column:
    """One line of at most `most` bytes (cut back to a whole character), then ..."""
    flat = F.regexp_replace(x, "[\n\r\t]", " ")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(flat.cast("binary"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(flat) > most, F.concat(cut, F.lit("..."))).otherwise(flat)


def invokes(command: Column, executable: str) -> Column:
    """Whether a shell command runs the executable, alone or behind a path or separator."""
    return command.rlike(rf"(^|[;&|(\s/]){executable}(\s|$)")


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def int_id(x: Column) -> Column:
    """The integer that a text is; null for other texts, whose rows are dropped."""
    return F.btrim(x).try_cast("int")


def short_sha(x: Column, digits: int) -> Column:
    return F.substring(F.sha1(x), 1, digits)


def chunk_id(file: Column, first: Column, last: Column) -> Column:
    return short_sha(F.concat_ws(":", file, first.cast("string"), last.cast("string")), 12)


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# --- errors --------------------------------------------------------------------------------------

# Message forms and their codes, in order, and HTTP statuses of codes.
ERROR_FORMS = (
    ("starts", "session not found: ", "SESSION_NOT_FOUND"), ("starts", "session already exists: ", "SESSION_ALREADY_EXISTS"), ("is", "invalid session id", "INVALID_SESSION_ID"),
    ("is", "not found", "NOT_FOUND"), ("is", "payload too large", "PAYLOAD_TOO_LARGE"), ("is", "Content-Type must be application/json", "UNSUPPORTED_MEDIA_TYPE"),
    ("has", " contains unknown field: ", "INVALID_REQUEST"), ("has", "must be", "INVALID_REQUEST"), ("has", "requires", "INVALID_REQUEST"),
    ("has", "exceeds maximum length", "INVALID_REQUEST"), ("has", "invalid", "INVALID_REQUEST"),
)
STATUS = {
    "SESSION_NOT_FOUND": 404, "NOT_FOUND": 404, "SESSION_ALREADY_EXISTS": 409, "UNSUPPORTED_MEDIA_TYPE": 415, "PAYLOAD_TOO_LARGE": 413,
    "INTERNAL_ERROR": 500, "INVALID_REQUEST": 400, "INVALID_SESSION_ID": 400, "BAD_REQUEST": 400,
}


def error_code(message: Column) -> Column:
    """The first form that the message has decides."""
    test = {"starts": lambda f: F.startswith(message, F.lit(f)), "is": lambda f: message == f, "has": lambda f: F.contains(message, F.lit(f))}
    out = F.lit("BAD_REQUEST")
    for kind, form, code in reversed(ERROR_FORMS):
        out = F.when(test[kind](form), F.lit(code)).otherwise(out)
    return out


def http_status(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.lit(400))


def error_details(message: Column) -> Column:
    """The map of details that goes with some forms."""
    after = lambda p: F.substring(message, F.lit(len(p) + 1), F.length(message))
    at = F.instr(message, " contains unknown field: ")
    field = F.substring(message, at + len(" contains unknown field: "), F.length(message))
    return (
        F.when(F.startswith(message, F.lit("session not found: ")), F.create_map(F.lit("session_id"), after("session not found: ")))
        .when(F.startswith(message, F.lit("session already exists: ")), F.create_map(F.lit("session_id"), after("session already exists: ")))
        .when(at > 0, F.create_map(F.lit("location"), F.substring(message, F.lit(1), at - 1), F.lit("field"), field))
    )
