"""Rule rows. Users add rules by adding rows; nothing here is logic.

The patterns, ids, weakness numbers, severities and rationales below are fixed values:
they must match exactly for the results to match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    rule_id: str
    cwe: str
    severity: str
    rationale: str
    pattern: str
    context: str | None = None
    languages: tuple[str, ...] | None = None  # None: all languages; (): none


# ---- fixed values: line rules ---------------------------------------------------------
TEXT_RULES = (
    Rule("dangerous-dynamic-code", "CWE-95", "high",
         "Dynamic evaluation can turn attacker-controlled data into code execution.",
         r"\beval\s*\(|\bnew\s+Function\s*\(", None, ()),
    Rule("shell-command-construction", "CWE-78", "high",
         "A constructed process command needs an attacker-to-shell data-flow review.",
         r"""(?i)(?:exec|execSync|spawn|spawnSync|system|popen|subprocess\.(?:run|call|Popen))\s*\([^\n]*(?:\+|`|\$\{|f["'])""",
         r"(?i)(?:req\.|params\.|query\.|argv|input|user)"),
    Rule("path-traversal-sink", "CWE-22", "medium",
         "A filesystem sink receives request-derived data and needs canonical containment validation.",
         r"(?i)(?:readFile|writeFile|createReadStream|createWriteStream|sendFile|open)\s*\([^\n]*(?:req\.|params\.|query\.|body\.|input)"),
    Rule("tls-verification-disabled", "CWE-295", "high",
         "TLS certificate verification is explicitly disabled.",
         r"(?:CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0))", None, ("csharp",)),
    Rule("ssrf-request-sink", "CWE-918", "medium",
         "An outbound request appears to use request-derived input and needs destination allowlisting.",
         r"(?i)(?:fetch|axios\.(?:get|post|request)|requests\.(?:get|post|request)|http\.request)\s*\([^\n]*(?:req\.|params\.|query\.|body\.|input)"),
    Rule("sql-injection-query-construction", "CWE-89", "high",
         "A database query appears to construct SQL syntax from request-derived input.",
         r"(?i)(?:query|execute|raw)\s*\([^\n]*(?:req\.|params\.|query\.|body\.|input|\+|\$\{)",
         r"(?i)(?:select|insert|update|delete|from|where)"),
)

# ---- fixed values: text rules that a flow job replaces, per language ----------------
FLOW_RULES = ("shell-command-construction", "path-traversal-sink", "ssrf-request-sink",
              "sql-injection-query-construction")
NATIVE_FLOW_RULES = ("shell-command-construction", "path-traversal-sink", "sql-injection-query-construction")
REPLACED_BY_FLOW = {
    "javascript": ("dangerous-dynamic-code", *FLOW_RULES),
    "typescript": ("dangerous-dynamic-code", *FLOW_RULES),
    "python": ("dangerous-dynamic-code", *FLOW_RULES, "unsafe-deserialization"),
    "go": FLOW_RULES,
    "java": (*FLOW_RULES, "unsafe-deserialization"),
    "csharp": (*FLOW_RULES, "unsafe-deserialization"),
    "php": (*FLOW_RULES, "unsafe-deserialization"),
    "ruby": (*FLOW_RULES, "unsafe-deserialization"),
    "c": NATIVE_FLOW_RULES,
    "cpp": NATIVE_FLOW_RULES,
    "rust": FLOW_RULES,
}

# ---- fixed values: scan passes (None = every rule) ------------------------------------
STANDARD_PASSES = {"baseline": None}
DEEP_PASSES = {
    "baseline": None,
    "injection": ("dangerous-dynamic-code", "shell-command-construction"),
    "boundaries": ("path-traversal-sink", "ssrf-request-sink", "tls-verification-disabled",
                   "hardcoded-secret-marker"),
}

# ---- fixed values: rules over deleted lines, in order ------------------------------------
REMOVED_CONTROL_RULES = (
    Rule("removed-authorization-control", "CWE-862", "high",
         "The patch removes an explicit authentication, authorization, permission, token, or CSRF control. An equivalent replacement was not established in the changed hunk.",
         r"(?i)(?:\b(?:require|ensure|check|enforce)(?:Auth(?:entication|orization)?|Permission|Access)|\b(?:authorize|isAuthorized|hasPermission|verify(?:Token|Jwt|JWT)|authenticate|authMiddleware|csrf(?:Protect|Middleware)|validateCsrf)\b|\.use\s*\(\s*(?:auth|authenticate|authorize))"),
    Rule("removed-input-validation-control", "CWE-20", "medium",
         "The patch removes an explicit input validation, parsing, allowlist, or sanitization control. An equivalent replacement was not established in the changed hunk.",
         r"(?i)(?:\b(?:validate(?:Input|Request|Schema)?|sanitize(?:Input)?|parse(?:Async)?|safeParse|allowlist|whitelist|escape(?:Html)?|check(?:Input|Schema)|isValid)\b|schema\.(?:parse|validate)|z\.[A-Za-z_]\w*\s*\()"),
)

# ---- fixed values: paired configuration rules ---------------------------------------------
CONFIGURATION_RULES = {
    "jwt": Rule("jwt-verification-disabled", "CWE-347", "high",
                "JWT signature validation is disabled or the token algorithm allowlist accepts the unsigned none algorithm.", ""),
    "cors": Rule("cors-wildcard-credentials", "CWE-942", "medium",
                 "A credentialed CORS policy allows every origin or reflects the caller origin without an explicit allowlist.", ""),
    "tls": Rule("tls-verification-disabled", "CWE-295", "high",
                "TLS certificate verification is explicitly disabled for a supported HTTP client request.", ""),
    "xml": Rule("xml-external-entity-risk", "CWE-611", "high",
                "A Java XML parser factory creates a parser without recognized external-entity hardening controls.", ""),
    "secret": Rule("hardcoded-secret-marker", "CWE-798", "medium",
                   "A credential-named field contains a non-placeholder string literal that should be moved to managed secret storage.", ""),
    "route": Rule("missing-authorization-route", "CWE-862", "medium",
                  "A state-changing route accepts a request handler without a local or previously registered explicit authorization middleware.", ""),
}

# ---- fixed values: CI workflow rules --------------------------------------------------------
CI_RULES = {
    "untrusted-shell": Rule("ci-untrusted-event-shell", "CWE-78", "high",
                            "A GitHub Actions workflow reachable from pull_request_target interpolates pull-request or issue event data into a shell command. A contributor-controlled value can alter the trusted runner command.", ""),
    "write-permissions": Rule("ci-pull-request-target-write-permissions", "CWE-269", "high",
                              "A pull_request_target workflow receives broad write permissions. Its trusted token must not be exposed to untrusted pull-request data or code.", ""),
    "mutable-action-ref": Rule("ci-mutable-action-ref", "CWE-829", "medium",
                               "A GitHub Actions workflow uses a mutable action branch reference. The action revision is not immutable and can change after review.", ""),
    "untrusted-checkout": Rule("ci-pull-request-target-untrusted-checkout", "CWE-829", "high",
                               "A pull_request_target workflow checks out contributor-controlled pull-request code and subsequently runs a command in the same job. The trusted workflow context can execute unreviewed code.", ""),
}

# ---- fixed values: credential field names and placeholder values ----------------------------
SECRET_FIELD = r"(?i)(?:api[_-]?key|access[_-]?key|secret|password|token|private[_-]?key|credential)"
PLACEHOLDER_VALUE = (r"(?i)(?:^|[-_\s])(example|sample|test|dummy|placeholder|replace|changeme|your[-_\s]?)(?:[-_\s]|$)"
                     r"|\.example(?:\.com|\.org|\.net)?$")
AUTHORIZATION_WORDS = (r"(?i)(?:auth(?:enticate|orize|entication|orization)?|permission|role|rbac|access(?:control)?"
                       r"|guard|csrf|(?:require|ensure|verify|check)Session)")

RULE_SCHEMA = ("rule_id string, cwe string, severity string, rationale string, pattern string, "
               "context string, languages array<string>")


def rule_table(spark: SparkSession, rules=TEXT_RULES) -> DataFrame:
    """Rules as rows, for users who extend or join them."""
    return spark.createDataFrame(
        [(r.rule_id, r.cwe, r.severity, r.rationale, r.pattern, r.context,
          None if r.languages is None else list(r.languages)) for r in rules], RULE_SCHEMA)


def rules_from_table(table: DataFrame, limit: int = 2_000) -> tuple[Rule, ...]:
    """Read a rule table into plan-time rules, so each pattern compiles once as a literal.

    A rule table is configuration; more than ``limit`` rows is refused rather than collected.
    """
    rows = table.select("rule_id", "cwe", "severity", "rationale", "pattern", "context", "languages").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules: split the table into several scans")
    return tuple(Rule(r.rule_id, r.cwe, r.severity, r.rationale, r.pattern, r.context,
                      None if r.languages is None else tuple(r.languages)) for r in rows)
