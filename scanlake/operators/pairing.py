"""Paired-control jobs: a setting and its use, a use without its guard, a chain in order.

All work on the fact rows of ``functions.facts``. Containment in a call or block is an
equi-join on the bracket position the fact carries, and "before / after" is one window per
file-local key, so no two facts of a file are ever paired just to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.facts import extract
from ..functions.rules import AUTHORIZATION_WORDS, CONFIGURATION_RULES, Rule
from ..scale import written
from .graph import reach
from .patterns import EVIDENCE, evidence, location

KEY = ["scan_id", "path"]
USED_HERE = {
    "jwt": "Token call that runs without the signature check.",
    "tls": "Outbound call that runs without the certificate check.",
}


def language_files(files: DataFrame, *languages: str) -> DataFrame:
    return files.filter(tx.classify_language(F.col("path")).isin(list(languages)))


def _spot(line: Column, text: Column, role: str) -> Column:
    return location(F.col("path"), line, tx.excerpt(text), role)


def _candidates(rows: DataFrame, rule: Rule, detail: Column, extra: Column, order: Column) -> DataFrame:
    """One candidate per (file, control line); of several uses the last gives the context."""
    c = rows.withColumn("_d", detail).withColumn("_x", extra)
    c = c.groupBy(*KEY, "line").agg(F.max_by(F.struct("text", "_d", "_x"), order).alias("m"))
    root = evidence("pattern", F.col("m._d"), _spot(F.col("line"), F.col("m.text"), "root_control"))
    return c.select("scan_id", F.lit(rule.rule_id).alias("rule"), F.lit(rule.severity).alias("severity"), F.col("path").alias("file"),
                    "line", tx.excerpt(F.col("m.text")).alias("excerpt"), F.lit(rule.rationale).alias("rationale"), F.lit(rule.cwe).alias("cwe"),
                    F.concat(F.array(root), F.col("m._x")).alias("evidence"), F.lit(200).alias("ord"))


def _kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.filter(F.col("kind").isin(list(kinds)))


def _first(rows: DataFrame, keys, cols=("line", "text", "start")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), "start").alias("f")).select(*keys, "f.*")


def inside_calls(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Facts within the parentheses of a call, at any depth: equi-join on the opening position."""
    held = facts.withColumn("call", F.explode("parens")).drop("parens")
    c = calls.select(*KEY, F.col("open").alias("call"), F.col("line").alias("call_line"), F.col("text").alias("call_text"), F.col("start").alias("call_start"))
    return held.join(c, [*KEY, "call"])


def bindings(facts: DataFrame, setting: str) -> DataFrame:
    """Named objects that hold the setting: the last binding of a name counts, its first setting is shown."""
    names = _kind(facts, "binding").select(*KEY, F.col("open").alias("brace"), F.col("g")[0].alias("name"), F.col("start").alias("b_start"))
    held = _kind(facts, setting).select(*KEY, F.try_element_at("braces", F.lit(-1)).alias("brace"), "line", "text", "start")
    j = names.join(held, [*KEY, "brace"])
    first = j.groupBy(*KEY, "name", "b_start").agg(F.min_by(F.struct("line", "text"), "start").alias("s"))
    return first.groupBy(*KEY, "name").agg(F.max_by("s", "b_start").alias("s")).select(*KEY, "name", "s.line", "s.text")


# ---- fixed values: fact patterns of the Python jobs ------------------------------------------------
JWT_FACTS = {
    "call": r"(?i)\bjwt\.(?:decode|verify)\s*\(",
    "direct": r"(?i)\bverify\s*=\s*False\b",
    "none": r"""(?i)\balgorithms\s*=\s*\[[^\]]*["']none["'][^\]]*\]""",
    "inline": r"(?i)\boptions\s*=\s*\{",
    "named": r"(?i)\boptions\s*=\s*([A-Za-z_]\w*)\b",
    "binding": r"\b([A-Za-z_]\w*)\s*=\s*\{",
    "off": r"""(?i)["']verify_signature["']\s*:\s*False\b""",
}
TLS_FACTS = {
    "call": r"(?i)\b(?:requests|httpx)\.(?:get|post|put|patch|delete|head|options|request)\s*\(",
    "direct": r"(?i)\bverify\s*=\s*False\b",
    "named": r"\*\*\s*([A-Za-z_]\w*)\b",
    "binding": r"\b([A-Za-z_]\w*)\s*=\s*\{",
    "off": r"""(?i)["']verify["']\s*:\s*False\b""",
}


def _call_controls(files: DataFrame, patterns, anchor: str, rule: Rule, used: str, notes: dict[str, str]) -> DataFrame:
    facts = written(extract(language_files(files, "python"), patterns, anchor))
    calls = _kind(facts, "call").filter("close is not null")
    held = inside_calls(_kind(facts, "direct", "none", "inline", "named"), calls)
    cols = [*KEY, "call", "call_line", "call_text", "call_start"]
    out = _first(_kind(held, "direct", "none"), [*cols, "kind"])
    if "inline" in patterns:
        obj = _first(_kind(held, "inline"), cols, ("start", "open")).select(*cols, F.col("open").alias("brace"))
        off = _kind(facts, "off").select(*KEY, F.try_element_at("braces", F.lit(-1)).alias("brace"), "line", "text", "start")
        inline = _first(obj.join(off, [*KEY, "brace"]), cols).withColumn("kind", F.lit("inline"))
        out = out.unionByName(inline)
    named = _first(_kind(held, "named"), cols, ("start", "g")).select(*cols, F.col("g")[0].alias("name"))
    bound = named.join(bindings(facts, "off"), [*KEY, "name"]).withColumn("kind", F.lit("named")).withColumn("start", F.lit(0))
    out = out.withColumn("name", F.lit("")).unionByName(bound.select(*out.columns, "name"))
    detail = None
    for kind, note in notes.items():
        text = F.concat(F.lit("Setting: "), F.format_string(note.replace("{}", "%s"), F.col("name")) if "{}" in note else F.lit(note))
        detail = F.when(F.col("kind") == kind, text) if detail is None else detail.when(F.col("kind") == kind, text)
    sink = F.array(evidence("context", F.lit(used), _spot(F.col("call_line"), F.col("call_text"), "sink")))
    return _candidates(out, rule, detail, sink, F.struct("call_start", "kind"))


def jwt_disabled(files: DataFrame) -> DataFrame:
    """Signature checks switched off in, or through a named options object passed to, a decode or verify call."""
    return _call_controls(files, JWT_FACTS, r"(?i)\bjwt\.(?:decode|verify)\s*\(", CONFIGURATION_RULES["jwt"], USED_HERE["jwt"], {
        "direct": "verify=False stands in the token call.", "inline": "the options written in the token call turn verify_signature off.",
        "named": "the token call takes its options from {}, which turns verify_signature off.", "none": "the token call accepts unsigned tokens (none)."})


def tls_disabled_calls(files: DataFrame) -> DataFrame:
    """Outbound calls with certificate checks off, directly or through expanded named options."""
    return _call_controls(files, TLS_FACTS, r"(?i)\b(?:requests|httpx)\.", CONFIGURATION_RULES["tls"], USED_HERE["tls"], {
        "direct": "verify=False stands in the request.", "named": "the request takes its options from {}, which turns verify off."})


# ---- ordered facts in one block ------------------------------------------------------------------------

def in_blocks(facts: DataFrame, anchor: str) -> DataFrame:
    """Anchor facts at their innermost block, all other facts at every enclosing block."""
    own = _kind(facts, anchor).withColumn("block", F.try_element_at("braces", F.lit(-1)))
    rest = facts.filter(F.col("kind") != anchor).withColumn("block", F.explode("braces"))
    return own.unionByName(rest).filter("block is not null")


def neighbours(events: DataFrame, keys, anchor: str, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """Anchor rows with the last earlier and first later fact of the given kinds for the same key.

    One window per key; a key never leaves one file, and a file is one row of the corpus.
    """
    back = W.partitionBy(*keys).orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys).orderBy("start", "kind").rowsBetween(1, W.unboundedFollowing)
    here = F.struct("start", "end", "line", "text", "g")
    for k in before:
        events = events.withColumn(f"prev_{k}", F.last(F.when(F.col("kind") == k, here), ignorenulls=True).over(back))
    for k in after:
        events = events.withColumn(f"next_{k}", F.first(F.when(F.col("kind") == k, here), ignorenulls=True).over(ahead))
    return events.filter(F.col("kind") == anchor)


# ---- fixed values: handle patterns, per API ----------------------------------------------------------------
HANDLE_APIS = {
    "php": ({"off": r"(?i)\bcurl_setopt\s*\(\s*(\$[A-Za-z_]\w*)\s*,\s*CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)\s*\)",
             "init": r"(\$[A-Za-z_]\w*)\s*=\s*curl_init\s*\(", "exec": r"(?i)\bcurl_exec\s*\(\s*(\$[A-Za-z_]\w*)\s*\)"},
            ("php",), "PHP curl handle, run further down in the block.",
            "Here the unchecked handle is run."),
    "native": ({"off": r"(?i)\bcurl_easy_setopt\s*\(\s*([A-Za-z_]\w*)\s*,\s*CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)(?:[uUlL]*)\s*\)",
                "init": r"\b([A-Za-z_]\w*)\s*=\s*curl_easy_init\s*\(", "exec": r"(?i)\bcurl_easy_perform\s*\(\s*([A-Za-z_]\w*)\s*\)"},
               ("c", "cpp"), "libcurl handle, run further down in the block.",
               "Here the unchecked handle is run."),
}


def handle_lifecycle(files: DataFrame, api: str) -> DataFrame:
    """One handle in one block: initialised, then checks switched off, then executed."""
    patterns, languages, detail, used = HANDLE_APIS[api]
    facts = written(extract(language_files(files, *languages), patterns, r"CURLOPT_SSL_VERIFYPEER"))
    events = in_blocks(facts, "off").withColumn("handle", F.col("g")[0])
    off = neighbours(events, [*KEY, "block", "handle"], "off", before=("init",), after=("exec",))
    off = off.filter("prev_init is not null and next_exec is not null")
    sink = F.array(evidence("context", F.lit(used), _spot(F.col("next_exec.line"), F.col("next_exec.text"), "sink")))
    note = F.lit(f"Setting: CURLOPT_SSL_VERIFYPEER is off for a {detail}")
    return _candidates(off, CONFIGURATION_RULES["tls"], note, sink, F.col("start"))


# ---- fixed values: Java parser facts -----------------------------------------------------------------------
XML_FACTS = {
    "factory": r"\b(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\s+(\w+)\s*=\s*(?:DocumentBuilderFactory\.newInstance|SAXParserFactory\.newInstance|XMLInputFactory\.newFactory)\s*\(\s*\)",
    "create": r"\b(\w+)\.(?:newDocumentBuilder|newSAXParser|createXMLStreamReader)\s*\(",
    "harden": r"(?i)\b(\w+)\.(?:setFeature|setAttribute|setProperty)\s*\([^;]*?(?:disallow-doctype-decl|external-general-entities|external-parameter-entities|ACCESS_EXTERNAL_(?:DTD|SCHEMA)|SUPPORT_DTD|IS_SUPPORTING_EXTERNAL_ENTITIES)",
}


def unhardened_use(files: DataFrame) -> DataFrame:
    """A parser created from a factory with no hardening between, in the factory's block."""
    facts = written(extract(language_files(files, "java"), XML_FACTS, r"(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)"))
    events = in_blocks(facts, "factory").withColumn("variable", F.col("g")[0])
    f = neighbours(events, [*KEY, "block", "variable"], "factory", after=("create", "harden"))
    f = f.filter("next_create is not null and (next_harden is null or next_harden.start > next_create.start)")
    f = f.select(*KEY, F.col("next_create.line").alias("line"), F.col("next_create.text").alias("text"), "variable", "start")
    note = F.concat(F.lit("Factory "), "variable", F.lit(" makes a parser and nothing before it closes external entities."))
    none = F.array().cast(f"array<{EVIDENCE}>")
    return _candidates(f, CONFIGURATION_RULES["xml"], note, none, F.col("start"))


# ---- fixed values: Go construction facts -----------------------------------------------------------------------
GO_TLS_FACTS = {
    "config": r"\b([A-Za-z_]\w*)\s*:=\s*&?tls\.Config\s*\{",
    "off": r"(?i)\bInsecureSkipVerify\s*:\s*true\b",
    "transport": r"\b([A-Za-z_]\w*)\s*:=\s*&?http\.Transport\s*\{",
    "transport_ref": r"\bTLSClientConfig\s*:\s*&?([A-Za-z_]\w*)",
    "client": r"\b([A-Za-z_]\w*)\s*:=\s*&?http\.Client\s*\{",
    "client_ref": r"\bTransport\s*:\s*&?([A-Za-z_]\w*)",
    "request": r"\b([A-Za-z_]\w*)\.(?:Get|Post|Head|Do)\s*\(",
}


def _bound(facts: DataFrame, maker: str, ref: str) -> DataFrame:
    """Constructed objects with the name they bind and every block they are seen from."""
    refs = _kind(facts, ref).select(*KEY, F.try_element_at("braces", F.lit(-1)).alias("open"), F.col("g")[0].alias("uses"))
    made = _kind(facts, maker).select(*KEY, "open", F.col("g")[0].alias("name"), "start", F.explode("braces").alias("block"))
    return made.join(refs, [*KEY, "open"]).select(*KEY, "block", "uses", "name", "start")


def construction_chain(files: DataFrame) -> DataFrame:
    """config -> transport -> client -> request, each bound by name, in one block, at growing offsets."""
    facts = written(extract(language_files(files, "go"), GO_TLS_FACTS, r"tls\.Config"))
    off = _kind(facts, "off").select(*KEY, F.try_element_at("braces", F.lit(-1)).alias("open"), F.col("line").alias("o_line"), F.col("text").alias("o_text"), F.col("start").alias("o_start"))
    config = _kind(facts, "config").select(*KEY, "open", F.col("g")[0].alias("uses"), F.col("start").alias("c_start"), F.try_element_at("braces", F.lit(-1)).alias("block"))
    config = config.join(off, [*KEY, "open"]).filter("block is not null")
    config = config.groupBy(*KEY, "block", "uses", "c_start").agg(F.min_by(F.struct("o_line", "o_text"), "o_start").alias("o"))
    step = lambda left, right, pos: left.join(right, [*KEY, "block", "uses"]).filter(F.col("start") > F.col(pos))
    t = step(config, _bound(facts, "transport", "transport_ref"), "c_start").groupBy(*KEY, "block", "c_start", "o", "name").agg(F.max("start").alias("t_start"))
    t = t.withColumnRenamed("name", "uses")
    c = step(t, _bound(facts, "client", "client_ref"), "t_start")
    c = c.groupBy(*KEY, "block", "c_start", "o", F.col("uses").alias("transport"), F.col("name").alias("uses")).agg(F.max("start").alias("k_start"))
    calls = _kind(facts, "request").select(*KEY, F.explode("braces").alias("block"), F.col("g")[0].alias("uses"), "start", F.col("line").alias("s_line"), F.col("text").alias("s_text"))
    hit = step(c, calls, "k_start").groupBy(*KEY, "c_start", "o", "transport", F.col("uses").alias("client")).agg(F.min_by(F.struct("s_line", "s_text"), "start").alias("s"))
    hit = hit.select(*KEY, F.col("o.o_line").alias("line"), F.col("o.o_text").alias("text"), "c_start", "transport", "client", "s")
    used = F.concat(F.lit("Request through client "), "client", F.lit(" and transport "), "transport", F.lit(", which hold the unchecked TLS settings."))
    sink = F.array(evidence("context", used, _spot(F.col("s.s_line"), F.col("s.s_text"), "sink")))
    note = F.lit("Setting: a tls.Config without the certificate check reaches a request of this file.")
    return _candidates(hit, CONFIGURATION_RULES["tls"], note, sink, F.struct("c_start", "client"))


# ---- objects and the calls they reach --------------------------------------------------------------------------

def object_calls(facts: DataFrame, settings: tuple[str, ...]) -> DataFrame:
    """Objects with their first setting of each kind, joined to the calls that take them inline or by name."""
    held = _kind(facts, *settings).withColumn("brace", F.try_element_at("braces", F.lit(-1))).filter("brace is not null")
    objects = held.groupBy(*KEY, "brace").agg(*[F.min_by(F.when(F.col("kind") == s, F.struct("line", "text", "start")), F.when(F.col("kind") == s, F.col("start"))).alias(s) for s in settings])
    calls = _kind(facts, "call").filter("close is not null").select(*KEY, F.col("open").alias("call"), "args", F.col("line").alias("call_line"), F.col("text").alias("call_text"))
    direct = held.select(*KEY, "brace", F.try_element_at("parens", F.lit(-1)).alias("call"), F.filter("braces", lambda b: b > F.try_element_at("parens", F.lit(-1))).alias("b")) \
        .filter(F.size("b") == 1).select(*KEY, "brace", "call").distinct()
    inline = direct.join(calls, [*KEY, "call"])
    last = _kind(facts, "binding").groupBy(*KEY, F.col("g")[0].alias("arg")).agg(F.max_by("open", "start").alias("brace"))
    named = calls.withColumn("arg", F.explode("args")).join(last, [*KEY, "arg"]).drop("arg")
    cols = [*KEY, "brace", "call", "call_line", "call_text"]
    return inline.select(*cols).unionByName(named.select(*cols)).distinct().join(objects, [*KEY, "brace"])


_BINDING = r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*=\s*\{"
# ---- fixed values: script-language settings and calls ------------------------------------------------------------
SCRIPT_TLS_FACTS = {
    "call": r"(?i)(?<![\w$.])(?:request|https\.(?:request|get)|tls\.(?:connect|createSecureContext)|https\.Agent)\s*\(",
    "off": r"""(?i)\brejectUnauthorized["']?\s*:\s*false\b""", "binding": _BINDING,
}
CORS_FACTS = {
    "call": r"(?i)(?<![\w$.])cors\s*\(",
    "credential": r"""(?i)\b(?:credentials|supportsCredentials)["']?\s*:\s*true\b|Access-Control-Allow-Credentials\s*['":=]+\s*['"]true""",
    "origin": r"""(?i)\b(?:origin|origins)["']?\s*:\s*(?:['"]\*['"]|true)(?!\w)|Access-Control-Allow-Origin\s*['":=]+\s*['"]\*""", "binding": _BINDING,
}
SCRIPT_TLS_RULE = Rule("tls-verification-disabled", "CWE-295", "high", "A TLS client configuration explicitly disables certificate verification.", "")


def config_reaches_call(files: DataFrame) -> DataFrame:
    """Script-language TLS object with checks off that reaches a TLS client call, inline or by name (line facts, no syntax tree)."""
    facts = written(extract(language_files(files, "javascript", "typescript"), SCRIPT_TLS_FACTS, r"(?i)rejectUnauthorized"))
    o = object_calls(facts, ("off",)).select(*KEY, F.col("off.line").alias("line"), F.col("off.text").alias("text"), "call", "call_line", "call_text")
    sink = F.array(evidence("context", F.lit("TLS client call that takes the object."), _spot(F.col("call_line"), F.col("call_text"), "sink")))
    return _candidates(o, SCRIPT_TLS_RULE, F.lit("A TLS client is set up with rejectUnauthorized: false."), sink, F.col("call"))


def paired_settings(files: DataFrame) -> DataFrame:
    """Wildcard or reflected origin and credential support in one CORS object; all languages.

    Script languages also resolve an object passed by name; elsewhere only inline objects count.
    """
    script = tx.classify_language(F.col("path")).isin("javascript", "typescript")
    facts = written(extract(files, CORS_FACTS, r"(?i)cors\s*\("))
    facts = facts.filter((F.col("kind") != "binding") | script)
    o = object_calls(facts, ("credential", "origin")).filter("credential is not null and origin is not null")
    o = o.select(*KEY, F.col("origin.line").alias("line"), F.col("origin.text").alias("text"), "credential", "call", "call_line", "call_text")
    notes = F.array(
        evidence("context", F.lit("Credentials are allowed here, in the same policy."), _spot(F.col("credential.line"), F.col("credential.text"), "expected_control")),
        evidence("context", F.lit("cors() call that takes the policy."), _spot(F.col("call_line"), F.col("call_text"), "sink")))
    note = F.lit("Setting: one CORS policy takes any origin and allows credentials.")
    return _candidates(o, CONFIGURATION_RULES["cors"], note, notes, F.col("call"))


# ---- routes and guards --------------------------------------------------------------------------------------------

_ROUTE = r"(?i)\b([A-Za-z_$][\w$]*)\.(%s)\s*\("
SCRIPT_ROUTE_FACTS = {
    "use": _ROUTE % "use", "route": _ROUTE % "post|put|patch|delete",
    "router": r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:(?:[A-Za-z_$][\w$]*\.)?Router)\s*\(",
}
_LITERAL = r"""(?s)^['"].*['"]\z|^`[^$]*`\z"""
_HANDLER = r"^(?:async\s+)?(?:function\b|\(?\s*(?:req|request|ctx)\b)|^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\z|^\["


def _route_candidates(rows: DataFrame, detail: str) -> DataFrame:
    rule = CONFIGURATION_RULES["route"]
    note = F.array(evidence("pattern", F.lit(detail), _spot(F.col("line"), F.col("text"), "root_control")))
    return rows.select("scan_id", F.lit(rule.rule_id).alias("rule"), F.lit(rule.severity).alias("severity"), F.col("path").alias("file"), "line",
                       tx.excerpt(F.col("text")).alias("excerpt"), F.lit(rule.rationale).alias("rationale"), F.lit(rule.cwe).alias("cwe"), note.alias("evidence"), F.lit(300).alias("ord"))


def unguarded_routes(files: DataFrame) -> DataFrame:
    """State-changing script routes with no route guard, earlier receiver guard or guarded mount (transitive).

    Route calls are recognised in every file, as the routes of one file share its receivers.
    """
    facts = written(extract(files, SCRIPT_ROUTE_FACTS, r"(?i)\.(?:post|put|patch|delete)\s*\("))
    guard = lambda a: a.rlike(AUTHORIZATION_WORDS)
    uses = _kind(facts, "use").filter("close is not null").withColumn("recv", F.col("g")[0])
    own = F.coalesce(F.exists("args", guard), F.lit(False))
    literal_first = F.coalesce(F.get("args", F.lit(0)).rlike(_LITERAL), F.lit(False))
    globally = uses.filter(own & ~literal_first).groupBy(*KEY, "recv").agg(F.min("start").alias("guard_at"))
    routers = _kind(facts, "router").select(*KEY, F.col("g")[0].alias("dst")).distinct()
    mounts = uses.select(*KEY, F.col("recv").alias("src"), "start", own.alias("own"), F.explode("args").alias("dst")).join(routers, [*KEY, "dst"])
    mounts = mounts.join(globally.withColumnRenamed("recv", "src"), [*KEY, "src"], "left")
    seeds = mounts.filter("own or guard_at < start").select(*KEY, F.col("dst").alias("node"))
    safe = reach(mounts.select(*KEY, "src", "dst").distinct(), seeds, KEY).withColumnRenamed("node", "recv")
    handler = F.try_element_at("args", F.lit(-1))
    middle = F.slice("args", F.lit(2), F.greatest(F.size("args") - 2, F.lit(0)))
    routes = _kind(facts, "route").filter("close is not null").filter(F.size("args") >= 2).withColumn("recv", F.col("g")[0]) \
        .filter(literal_first & handler.rlike(_HANDLER) & ~handler.rlike(AUTHORIZATION_WORDS) & ~F.exists(middle, guard))
    open_ = routes.join(safe, [*KEY, "recv"], "left_anti").join(globally, [*KEY, "recv"], "left").filter("guard_at is null or guard_at >= start")
    return _route_candidates(open_, "Writing route: no guard in the route, none used by its router before it, none where the router is mounted.")


_AUTH = AUTHORIZATION_WORDS.replace("(?i)", "")
_DEPENDS = r"Depends\s*\([^)]*(?:current[_-]?user|require[_-]?session)"
PYTHON_ROUTE_FACTS = {
    "route": r"(?i)@([A-Za-z_]\w*)\.(?:post|put|patch|delete)\s*\(",
    "def": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+[A-Za-z_]\w*\s*\(",
    "router": r"\b([A-Za-z_]\w*)\s*=\s*APIRouter\s*\(", "include": r"\b([A-Za-z_]\w*)\.include_router\s*\(",
    "auth": rf"(?i){_AUTH}|Secured|RolesAllowed|PermitAll|DenyAll|{_DEPENDS}",
}


def unguarded_python_routes(files: DataFrame) -> DataFrame:
    """Decorated state-changing handlers without a guard in the decorator, later decorators, parameters or router."""
    facts = written(extract(language_files(files, "python"), PYTHON_ROUTE_FACTS, r"(?i)@[A-Za-z_]\w*\.(?:post|put|patch|delete)\s*\("))
    words = rf"(?i){_AUTH}|Secured|RolesAllowed|PermitAll|DenyAll|{_DEPENDS}"
    guarded = F.coalesce(F.exists("args", lambda a: a.rlike(words)), F.lit(False))
    routers = _kind(facts, "router").select(*KEY, F.col("g")[0].alias("recv"), guarded.alias("safe"))
    mounted = _kind(facts, "include").filter(guarded).select(*KEY, F.explode("args").alias("recv"))
    safe = routers.filter("safe").select(*KEY, "recv").unionByName(mounted.join(routers.select(*KEY, "recv"), [*KEY, "recv"], "left_semi")).distinct()
    # nearest following handler and nearest guard words, in file order
    order = W.partitionBy(*KEY).orderBy("at", "kind").rowsBetween(1, W.unboundedFollowing)
    nxt = lambda k: F.first(F.when(F.col("kind") == k, F.struct("start", "open", "close")), ignorenulls=True).over(order)
    at = F.when(F.col("kind").isin("route", "def"), F.col("open")).otherwise(F.col("start"))
    # only what the order needs is moved; line, text and arguments with routes alone
    own = lambda c: F.when(F.col("kind") == "route", c)
    f = _kind(facts, "route", "def", "auth").select(*KEY, "kind", "start", "open", "close", at.alias("at"), own(F.col("line")).alias("line"), own(F.col("text")).alias("text"),
                                                    own(F.get("g", F.lit(0))).alias("recv"), own(F.get("args", F.lit(0)).rlike("^['\"]")).alias("quoted"))
    f = f.withColumn("handler", nxt("def")).withColumn("word", nxt("auth"))
    defs = _kind(f, "def").select(*KEY, F.col("start").alias("d_start"), (F.col("word.start") < F.col("close")).alias("in_params"))
    routes = _kind(f, "route").filter("close is not null and quoted").withColumn("d_start", F.col("handler.start")).filter("d_start is not null")
    early = F.coalesce(F.col("word.start") < F.col("d_start"), F.lit(False))
    routes = routes.filter(~early).join(defs, [*KEY, "d_start"]).filter(~F.coalesce("in_params", F.lit(False)))
    return _route_candidates(routes.join(safe, [*KEY, "recv"], "left_anti"),
                             "Writing route: no guard in its decorators, its parameters or its router.")


_NOTES = r"((?:^[ \t]*(?:@[^\n]*)?\n)*)"
JAVA_ROUTE_FACTS = {
    "route": rf"(?mi){_NOTES}[ \t]*@(?P<spot>PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\b(?:\s*\(([^)]*)\))?[^\n]*\n((?:[ \t]*@[^\n]*\n|[ \t]*\n)*)(?=[^\n@;{{}}]*\([^)]*\)[^{{;]*\{{)",
    "class": rf"(?m){_NOTES}(?:[ \t]*@[^\n]*[ \t])?[ \t]*class\s+[A-Za-z_]\w*(?:\s+(?:extends|implements)\s+[^\{{]+)?\s*\{{",
}


def unguarded_java_routes(files: DataFrame) -> DataFrame:
    """Mapped state-changing methods without an authorization annotation on the method or its outermost class."""
    facts = written(extract(language_files(files, "java"), JAVA_ROUTE_FACTS, r"(?i)@(?:Post|Put|Patch|Delete|Request)Mapping"))
    words = rf"(?i){_AUTH}|Secured|RolesAllowed|PermitAll|DenyAll"
    text = lambda i: F.get("g", F.lit(i))
    writes = (F.lower(text(1)) != "requestmapping") | text(2).rlike(r"(?i)RequestMethod\.(?:POST|PUT|PATCH|DELETE)\b")
    routes = _kind(facts, "route").filter(writes & ~F.concat_ws("\n", text(0), text(3)).rlike(words)).withColumn("block", F.get("braces", F.lit(0)))
    classes = _kind(facts, "class").filter(text(0).rlike(words)).select(*KEY, F.col("open").alias("block")).distinct()
    routes = routes.join(classes, [*KEY, "block"], "left_anti")
    return _route_candidates(routes, "Writing route: no guard annotation on the method or its class.")
