"""Failure taxonomy: prioritised patterns that sort error messages into categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (rule id, category, priority, patterns, tags).
RULES: list[tuple[str, str, int, list[str], list[str]]] = [
    ("limits.http_429", "Timeout / throttling", 130, [r"\bhttp(?: status)?[ /:]?429\b", r"\b429 too many requests\b"], ["HTTP 429", "Rate limit"]),
    ("authorization.http_403", "Authorization", 130, [r"\bhttp(?: status)?[ /:]?403\b", r"\b403 forbidden\b"], ["HTTP 403"]),
    ("authentication.http_401", "Authentication", 130, [r"\bhttp(?: status)?[ /:]?401\b", r"\b401 unauthorized\b"], ["HTTP 401"]),
    ("resource.out_of_memory", "Resource / capacity", 125, [r"\boutofmemoryerror\b", r"\bout of memory\b", r"\boom killed\b", r"\bmemory limit exceeded\b"], ["Memory"]),
    ("resource.disk_full", "Resource / capacity", 125, [r"\bno space left on device\b", r"\bdisk (?:is )?full\b", r"\bstorage (?:limit|capacity) exceeded\b"], ["Storage"]),
    ("concurrency.deadlock", "Concurrency / conflict", 125, [r"\bdeadlock(?:ed)?\b"], ["Deadlock"]),
    ("concurrency.delta_write_conflict", "Concurrency / conflict", 121, [r"\bdelta_concurrent\w*\b"], ["Concurrent write", "Delta"]),
    ("concurrency.write_conflict", "Concurrency / conflict", 120, [r"\bconcurrent (?:write|modification|update)\b", r"\bwrite conflict\b", r"\bversion conflict\b"], ["Concurrent write"]),
    ("dependency.module_not_found", "Dependency", 120, [r"\bmodulenotfounderror\b", r"\bno module named\b", r"\bmodule not found\b"], ["Module"]),
    ("connectivity.connection_refused", "Connectivity", 115, [r"\bconnection refused\b", r"\bfailed to establish a new connection\b"], ["Connection refused"]),
    ("connectivity.dns", "Connectivity", 115, [r"\bgetaddrinfo\b", r"\bdns (?:lookup|resolution|failure|error)\b", r"\bname or service not known\b", r"\bhost not found\b"], ["DNS"]),
    ("schema.cast", "Schema / format", 115, [r"\bcannot cast\b", r"\bcast error\b", r"\bconversion error\b"], ["Cast", "Data type"]),
    ("schema.type_mismatch", "Schema / format", 115, [r"\btype mismatch\b", r"\bdata[ _-]?type mismatch\b", r"\bincompatible (?:data )?types?\b", r"\bfailed to merge fields\b"], ["Data type"]),
    ("missing.object", "Missing object", 110, [r"\b(?:table|view|file|path|column|database|schema)\b.{0,48}\b(?:not found|does not exist|missing)\b", r"\bno such (?:table|view|file|path|column|database|schema)\b", r"\btable or view\b.{0,48}\bdoes not exist\b", r"\bpath does not exist\b", r"\bmissing (?:delta )?(?:table|view|file|path|column|database|schema|object)\b"], ["Object lookup"]),
    ("format.parse", "Schema / format", 110, [r"\bparse(?:r|ing)? (?:error|failed|failure)\b", r"\bmalformed (?:json|csv|xml|record|payload)\b", r"\bcorrupt(?:ed)? (?:file|parquet|record|data)\b", r"\binvalid (?:json|csv|xml|parquet)\b"], ["Parsing"]),
    ("quality.assertion", "Data quality", 110, [r"\bassertion(?:error)?\b", r"\bdata quality (?:check|rule|validation) failed\b", r"\bexpectation failed\b"], ["Assertion"]),
    ("authorization.permission", "Authorization", 105, [r"\bpermission denied\b", r"\baccess denied\b", r"\binsufficient privileges?\b", r"\bnot authorized\b", r"\bforbidden\b"], ["Permission"]),
    ("limits.rate_limit", "Timeout / throttling", 105, [r"\brate limit(?:ed| exceeded)?\b", r"\btoo many requests\b", r"\bthrottl(?:e|ed|ing)\b", r"\bquota exceeded\b"], ["Rate limit"]),
    ("connectivity.reset", "Connectivity", 105, [r"\bconnection reset\b", r"\bnetwork is unreachable\b", r"\bhost unreachable\b", r"\bbroken pipe\b"], ["Network"]),
    ("limits.timeout", "Timeout / throttling", 100, [r"\btimed out\b", r"\btimeout(?:error| exception)?\b", r"\bdeadline exceeded\b", r"\brequest timeout\b"], ["Timeout"]),
    ("authentication.oauth", "Authentication", 95, [r"\boauth2?\b", r"\binvalid[_ ]client\b"], ["OAuth"]),
    ("authentication.credential", "Authentication", 95, [r"\bauthentication failed\b", r"\binvalid credentials?\b", r"\bexpired (?:credential|token)\b", r"\binvalid token\b", r"\btoken expired\b"], ["Credential"]),
    ("configuration.missing", "Configuration", 95, [r"\bmissing (?:required )?(?:configuration|config|setting|option|parameter)\b", r"\brequired (?:configuration|config|setting|option|parameter)\b.{0,32}\bmissing\b"], ["Missing configuration"]),
    ("configuration.invalid", "Configuration", 90, [r"\binvalid (?:configuration|config|setting|option|parameter)\b", r"\bunsupported (?:configuration|setting|option|parameter)\b", r"\bconfiguration error\b"], ["Invalid configuration"]),
    ("dependency.package_required", "Dependency", 90, [r"\b(?:pip|conda|poetry)\s+install\b", r"\brequired package\b", r"\bmissing package\b"], ["Package"]),
    ("schema.incompatible", "Schema / format", 90, [r"\bincompatible schema\b", r"\bschema mismatch\b", r"\bschema evolution (?:error|failed|failure)\b", r"\bis not a delta table\b"], ["Schema"]),
    ("quality.constraint", "Data quality", 90, [r"\bconstraint (?:violation|failed|failure)\b", r"\bvalidation (?:error|failed|failure)\b", r"\binvalid (?:value|record|row|data)\b"], ["Validation"]),
    ("quality.null_duplicate", "Data quality", 90, [r"\bnull value\b.{0,40}\bnot allowed\b", r"\bduplicate (?:key|record|row)\b", r"\buniqueness (?:check|constraint) failed\b"], ["Invalid data"]),
    ("resource.executor", "Resource / capacity", 85, [r"\bexecutor lost\b", r"\bresource exhausted\b", r"\binsufficient resources?\b", r"\btask killed due to resource\b"], ["Compute"]),
    ("concurrency.lock", "Concurrency / conflict", 85, [r"\block (?:wait )?timeout\b", r"\bcould not obtain lock\b", r"\boptimistic concurrency\b"], ["Lock"]),
    ("runtime.syntax", "Runtime / code", 80, [r"\bsyntaxerror\b", r"\bsyntax error\b", r"\bparserexception\b"], ["Syntax"]),
    ("runtime.reference", "Runtime / code", 80, [r"\bnameerror\b", r"\battributeerror\b", r"\bnullpointerexception\b", r"\bkeyerror\b", r"\bindexerror\b"], ["Code"]),
    ("runtime.execution", "Runtime / code", 60, [r"\bexecution (?:error|failed|failure)\b", r"\bruntimeerror\b", r"\btask execution failed\b"], ["Execution"]),
]
#: Fixed value: identifiers with semicolons between them aren't a message.
LIST_LIKE = r"^[a-z0-9_:\-./]+(?:\s*;\s*[a-z0-9_:\-./]+)+$"
BY_RANK = sorted(RULES, key=lambda r: (-r[2], r[0]))


def hit(rule: tuple, message: Column) -> Column:
    return F.lower(F.trim(message)).rlike("|".join(rule[3]))


def _first(message: Column, value: int, blank: str | None, listed: str | None, none: str | None) -> Column:
    low = F.lower(F.trim(message))
    out = F.when(low.isin("", "none"), F.lit(blank)).when(low.rlike(LIST_LIKE), F.lit(listed))
    for rule in BY_RANK:
        out = out.when(hit(rule, message), F.lit(rule[value]))
    return out.otherwise(F.lit(none))


def failure_category(message: Column) -> Column:
    """Category of the first rule by priority, then id; `Unspecified` if blank, `Other` if none."""
    return _first(message, 1, "Unspecified", "Other", "Other")


def failure_rule_id(message: Column) -> Column:
    return _first(message, 0, None, None, None)


def failure_tags(messages: Column, category: Column) -> Column:
    """Categories and tags of all rules that hit, but the main category; sorted, the first five."""
    none = F.array().cast("array<string>")
    hits = [F.when(hit(r, messages), F.array(F.lit(r[1]), *map(F.lit, r[4]))).otherwise(none) for r in BY_RANK]
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.concat(*hits), lambda x: x != category))), 1, 5)


def normalize_message(message: Column) -> Column:
    """Ids, times and numbers as placeholders; white space collapsed; 360 characters."""
    out = F.lower(F.trim(message))
    # fixed values: what counts as an id, a time or a number, and what stands for it
    for pattern, mark in (
        ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t ][0-9:.+\-z]+)?\b", "<timestamp>"),
        (r"\b[0-9]+\b", "<number>"),
        (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, mark)
    return F.substring(out, 1, 360)
