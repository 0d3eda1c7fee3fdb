"""Expressions over task, event, command and call-trace records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.functions.paths import _c, any_of


def confidence_level(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s.isNull(), "medium").when(s >= 0.8, "high").when(s >= 0.5, "medium").otherwise("low")


def confidence_rank(level: Column | str) -> Column:
    c = _c(level)
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def edge_confidence(metadata: Column | str) -> Column:
    """The ``confidence`` number inside an edge's JSON metadata; bad JSON gives null."""
    return F.get_json_object(_c(metadata), "$.confidence").cast("double")


def compile_rank(status: Column | str) -> Column:
    c = _c(status)
    return F.when(c == "compiled", 0).when(c == "not_compiled", 1).when(c == "excluded", 2).otherwise(3)


def compile_from_rank(rank: Column) -> Column:
    return F.when(rank == 0, "compiled").when(rank == 1, "not_compiled").when(rank == 2, "excluded").otherwise("unknown")


def payload_json(text: Column | str) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is no such pair."""
    return F.nullif(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1), F.lit(""))


def structured_payload(text: Column | str) -> Column:
    """``finding`` for an object with a findings list, ``verdict`` for a verdict object, else null."""
    raw = payload_json(text)
    v = F.try_parse_json(raw)
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    findings = F.get_json_object(raw, "$.findings")
    keys = F.json_object_keys(F.when(v.isNotNull(), raw))
    verdict = F.arrays_overlap(keys, F.array(F.lit("conclusion"), F.lit("build"), F.lit("tests")))
    return F.when(v.isNotNull() & is_object & F.startswith(F.ltrim(findings), F.lit("[")), "finding").when(
        v.isNotNull() & is_object & F.coalesce(verdict, F.lit(False)), "verdict"
    )


def is_high_risk_command(command: Column | str) -> Column:
    return F.rlike(_c(command), F.lit("(?i)" + "|".join(f"(?:{p})" for p in fixed.RISKY_COMMANDS)))


def extract_command(text: Column | str) -> Column:
    """First known tool invocation in a text, else the trimmed text."""
    t = F.trim(_c(text))
    found = F.trim(F.regexp_extract(t, fixed.COMMAND_PATTERN, 1))
    return F.when(found != "", found).otherwise(t)


def command_norm(command: Column | str) -> Column:
    """Without notes in ASCII or full-width parentheses and without blanks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(command), F.lit("")), r"（[^）]*）|\([^)]*\)", ""), r"\s+", "")


def command_parts(command: Column | str) -> Column:
    """Normalised steps of a compound command."""
    plain = F.regexp_replace(F.coalesce(_c(command), F.lit("")), r"（[^）]*）|\([^)]*\)", "")
    return F.filter(F.transform(F.split(plain, r"&&|\|\||;|\n"), command_norm), lambda p: p != "")


def classify_error(status: Column | str, body: Column | str) -> Column:
    s, b = _c(status), F.lower(_c(body))
    bad = s.isin(400, 422)
    return (
        F.when(s.isin(401, 403), "authentication")
        .when(s == 429, "rate_limit")
        .when(s == 413, "context_length")
        .when(bad & F.rlike(b, F.lit(any_of(fixed.PARAM_WORDS))), "invalid_parameter")
        .when(bad & F.rlike(b, F.lit(any_of(fixed.MODEL_WORDS))), "invalid_model")
        .when(bad & F.rlike(b, F.lit(any_of(fixed.CONTEXT_WORDS))), "context_length")
        .when(bad, "invalid_parameter")
        .when(s >= 500, "provider_error")
        .otherwise("unknown")
    )


def classify_transport_error(kind: Column | str) -> Column:
    k = _c(kind)
    return (
        F.when(k == "timeout", "request_timeout").when(k.isin("close", "protocol", "read"), "provider_cancel")
        .otherwise("provider_error")
    )


def sanitize_text(data: Column | str) -> Column:
    """Bytes as text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(_c(data).cast("string"))


def role_for(sender: Column | str) -> Column:
    s = _c(sender)
    out = F.when(F.startswith(s, F.lit("executor")), "executor")
    for role in ("reviewer", "verifier"):
        out = out.when(F.startswith(s, F.lit(role)), role)
    return out.otherwise(s)


def cpu_of(cpu: Column | str) -> Column:
    """Name inside ``CPUTYPE("…")``, else the first word; null for an empty text."""
    raw = F.coalesce(_c(cpu), F.lit(""))
    named = F.regexp_extract(raw, r'CPUTYPE\("([^"]+)"\)', 1)
    first = F.regexp_extract(F.trim(raw), r"^(\S+)", 1)
    return F.when(named != "", named).when(first != "", first)


def chip_of(defines: Column | str) -> Column:
    """First define that starts with a known chip family."""
    pattern = "^" + any_of(fixed.CHIP_PREFIXES)
    return F.try_element_at(F.filter(_c(defines), lambda d: F.rlike(F.lower(d), F.lit(pattern))), F.lit(1))


def operation_class(action: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.ACTION_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(action)), F.lit("CODE_WRITE"))


def decide_index_action(state: Column | str, force: Column | str) -> Column:
    s = F.upper(_c(state))
    return F.when(_c(force), "rebuild").when(s == "VALID", "reuse").when(s == "STALE", "sync").otherwise("rebuild")


def decide_index_reason(state: Column | str, force: Column | str) -> Column:
    s = F.upper(_c(state))
    return (
        F.when(_c(force), "user requested rebuild")
        .when(s.isin("VALID", "STALE"), F.lit(None).cast("string"))
        .when(s.isin("MISSING", "CORRUPTED"), "index missing / corrupted")
        .otherwise(F.concat(F.lit("unknown index state: "), _c(state)))
    )


def compact_event(payload: Column | str) -> Column:
    """``key=value`` of the six known keys, in their fixed order, of a JSON payload."""
    parts = [
        F.concat(F.lit(k + "="), F.get_json_object(_c(payload), f"$.{k}")) for k in fixed.EVENT_KEYS
    ]
    return F.concat_ws(" ", *parts)


def progress_text(event_type: Column | str, payload: Column | str, agent: Column | str) -> Column:
    """Short line for an event; null for an event that shows nothing."""
    t, p = _c(event_type), _c(payload)
    tool = F.coalesce(F.get_json_object(p, "$.tool"), F.lit(""))
    path, cmd = F.get_json_object(p, "$.args.path"), F.get_json_object(p, "$.args.command")
    detail = F.coalesce(F.concat(F.lit(" "), F.coalesce(F.nullif(path, F.lit("")), F.substring(cmd, 1, 40))), F.lit(""))
    ok = F.when(F.get_json_object(p, "$.ok") == "true", "[OK]").otherwise("[FAIL]")
    return (
        F.when(t == "AgentThinking", "思考中...")
        .when(t == "ToolStarted", F.concat(F.lit("工具: "), tool, detail))
        .when(t == "ToolFinished", F.concat(F.lit("完成: "), tool, F.lit(" "), ok))
        .when(t == "AgentStarted", F.concat(F.coalesce(_c(agent), F.lit("")), F.lit(" 开始工作")))
    )
