"""File-level classification: eligibility, previews, risk signals, surfaces, strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.scans import scan_keys

# ---- fixed values: directories, names and extensions for ranking ------------------------------
EXCLUDED_DIRS = """.cache .circleci .devcontainer .git .github .idea .mypy_cache .pytest_cache .ruff_cache .tox .venv .vscode
__pycache__ bench benchmark bintest build build_config build_configs build-tools build_tools ci coverage deps dev dist doc docs
example examples external extern fixture fixtures generated node_modules sample samples target test tests testing third-party
third_party tmp vendor""".split()
EXCLUDED_NAMES = """.DS_Store CHANGELOG CHANGELOG.md CONTRIBUTING.md Dockerfile Gemfile Gemfile.lock LICENSE LICENSE.md Makefile
NEWS NEWS.md NOTICE README README.md README.rst Rakefile SECURITY.md TODO TODO.md docker-compose.yml package-lock.json
pnpm-lock.yaml yarn.lock""".split()
CODE_EXTENSIONS = """.c .cc .cfg .clj .cpp .cs .css .cue .cxx .dart .ex .exs .go .graphql .h .hpp .hs .html .java .js .json .jsx .kt
.kts .lua .mjs .mm .php .proto .py .rb .rs .scala .sh .sql .swift .toml .ts .tsx .vue .xml .yaml .yml""".split()
NON_PRODUCT = r"(?i)(?:^|/)(?:test|tests|fixtures?|examples?|docs?)(?:/|$)"


def path_excluded(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) \
        | F.coalesce(F.try_element_at(parts, F.lit(-1)).isin(EXCLUDED_NAMES), F.lit(False))


def ranking_eligible(path: Column) -> Column:
    return ~path_excluded(path) & F.lower(tx.extension(path)).isin(CODE_EXTENSIONS)


# ---- fixed values: structural outline: label and line pattern (group 1 is the name) ----------------
OUTLINE = (
    ("class ", r"^\s*(?:async\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("def ", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function ", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
    ("arrow ", r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\(.*\)\s*=>"),
    ("func ", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\("),
)
METHOD = r"^\s*(?:(?:public|private|protected|static|final|abstract)\s*)*\S+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*\{?"


def outline_label(line: Column) -> Column:
    out = None
    for label, pattern in OUTLINE:
        hit, text = line.rlike(pattern), F.concat(F.lit(label), F.regexp_extract(line, pattern, 1))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.when(line.rlike(METHOD) & ~F.contains(line, F.lit("=")), F.concat(F.lit("method "), F.regexp_extract(line, METHOD, 1)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row; inside a lambda an expression would be worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def structural_outline(content: Column) -> Column:
    """Labels of the first 24 lines; once 12 are held, the first line without a label ends the list."""
    lines = F.slice(tx.split_lines(content), 1, 24)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))

    def step(acc, label):
        return F.struct(
            F.when(~acc.stop & label.isNotNull(), F.concat(acc.out, F.array(label))).otherwise(acc.out).alias("out"),
            (acc.stop | (label.isNull() & (F.size(acc.out) >= 12))).alias("stop"))
    return F.array_distinct(F.aggregate(F.transform(lines, outline_label), empty, step, lambda acc: acc.out))


def sample_lines(content: Column, count: int = 10) -> Column:
    """``count`` spread lines, or all of a short file."""
    def chosen(lines):
        n = F.size(lines)
        step = F.greatest(F.lit(1), F.floor((n - 1) / F.lit(count - 1)).cast("int"))
        spread = F.transform(F.slice(F.sequence(F.lit(0), n - 1, step), 1, count), lambda i: F.get(lines, i))
        return F.when(n <= count + 1, F.slice(lines, 1, count)).otherwise(spread)
    return _once(tx.split_lines(content), chosen)


def file_preview(content: Column, budget: int = 1024) -> Column:
    """Outline plus spread lines, as many as fit the byte budget (at least one); '' for binary files."""
    clean = F.regexp_replace(content, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    parts = _once(clean, lambda c: F.concat(structural_outline(c), sample_lines(c)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"), F.lit(False).alias("stop"))

    def step(acc, line):
        size = F.octet_length(line)
        full = acc.stop | ((acc.total + size > budget) & (F.size(acc.out) > 0))
        return F.struct(F.when(full, acc.out).otherwise(F.concat(acc.out, F.array(line))).alias("out"),
                        F.when(full, acc.total).otherwise(acc.total + size).alias("total"),
                        (full | (acc.total + size >= budget)).alias("stop"))
    fitted = F.aggregate(parts, start, step, lambda acc: acc.out)
    return F.when(tx.is_binary(content), "").otherwise(F.array_join(fitted, "\n"))


# ---- fixed values: risk signals in order: label, pattern, over the path alone? ---------------------
RISK_SIGNALS = (
    ("externally reachable request surface", r"(?i)(?:^|/)(?:routes?|controllers?|handlers?|api|server|middleware)(?:/|\.|$)|\b(?:app|router)\.(?:get|post|put|delete|use)\b", False),
    ("execution or query sink", r"(?i)\b(?:eval|Function|exec(?:File)?|spawn|system|child_process|Runtime\.getRuntime)\b|\b(?:SELECT|INSERT|UPDATE|DELETE)\b", False),
    ("outbound network or transport control", r"(?i)\b(?:fetch|axios|request|http\.request|https\.request|urlopen|net\.Dial)\b|rejectUnauthorized\s*:\s*false|InsecureSkipVerify", False),
    ("authorization or identity control", r"(?i)\b(?:auth|authori[sz]|permission|role|session|jwt|token|oauth)\b", False),
    ("credential or key material", r"(?i)\b(?:secret|password|api[_-]?key|private[_-]?key|credential)\b", False),
    ("build or supply-chain control", r"(?i)(?:^|/)(?:\.github/workflows|Dockerfile|package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|go\.sum)(?:$|/)", True),
    ("parser or deserialization boundary", r"(?i)\b(?:deserialize|pickle|yaml\.load|XMLParser|ObjectInputStream|unserialize)\b", False),
)


# Words of which a text must hold one (in lower case) before the pattern is tried.
RISK_WORDS = (
    ("route", "controller", "handler", "api", "server", "middleware", "app.", "router."),
    ("eval", "function", "exec", "spawn", "system", "child_process", "runtime.getruntime", "select", "insert", "update", "delete"),
    ("fetch", "axios", "request", "urlopen", "net.dial", "rejectunauthorized", "insecureskipverify"),
    ("auth", "permission", "role", "session", "jwt", "token"),
    ("secret", "password", "api", "private", "credential"),
    ("workflows", "dockerfile", "package", "pnpm-lock", "yarn.lock", "cargo.lock", "go.sum"),
    ("deserialize", "pickle", "yaml.load", "xmlparser", "objectinputstream", "unserialize"),
)
THREAT_WORDS = (
    ("app.", "router.", "flask", "fastapi"), ("req", "input"), ("auth", "isadmin", "passport", "permission", "rbac"),
    ("fetch", "axios", "requests.", "http"), ("file", "stream", "open", "query", "execute", "save", "delete"),
    ("secret", "password", "api", "token", "private"), ("json.parse", "yaml.load", "pickle.loads", "unserialize", "xml", "documentbuilderfactory"),
)


def holds_any(lowered: Column, words) -> Column:
    """Plain byte search for any of the words: far cheaper than trying a pattern at every position."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lowered, F.lit(w))
    return out


def risk_signals(path: Column, content: Column, build_signal: bool = True) -> Column:
    """Ordered signal labels. Region level uses all seven, file level leaves the build signal out."""
    both = F.concat(path, F.lit("\n"), content)
    lowered = F.lower(both)
    return tx.compact(*[F.when(holds_any(F.lower(path) if path_only else lowered, words) & (path if path_only else both).rlike(tx.ascii_words(p.replace("$", r"\z"))), label)
                        for (label, p, path_only), words in zip(RISK_SIGNALS, RISK_WORDS) if build_signal or not path_only])


# ---- fixed values: threat-model signals in order: key, label, pattern -----------------------------------
THREAT_SIGNALS = (
    ("routes", "request-handling or route declaration", r"(?i)\b(?:app|router)\.(?:get|post|put|patch|delete)\s*\(|@(?:app|router)\.(?:get|post|put|patch|delete)|\b(?:Flask|FastAPI)\s*\("),
    ("request_inputs", "caller-controlled input access", r"(?i)\b(?:req|request|ctx\.request)\.(?:body|query|params|headers|cookies)|\binput\s*\("),
    ("auth", "authentication or authorization control", r"(?i)\b(?:auth(?:enticate|orize|entication|orization)?|requireAuth|isAdmin|passport|permission|rbac)\b"),
    ("outbound", "outbound network operation", r"(?i)\b(?:fetch|axios|requests\.(?:get|post|request)|http\.request|https\.request)\s*\("),
    ("storage", "filesystem or data-store operation", r"(?i)\b(?:readFile|writeFile|createReadStream|createWriteStream|open|query|execute|save|delete)\s*\("),
    ("secrets", "credential or secret handling", r"(?i)\b(?:secret|password|api[_-]?key|token|private[_-]?key)\b"),
    ("parsers", "structured-data parser or deserialization", r"(?i)\b(?:JSON\.parse|yaml\.load|pickle\.loads|unserialize|XML|DocumentBuilderFactory)\b"),
)


def threat_signals(files: DataFrame) -> DataFrame:
    """Files per signal, one row per scan: one map-side pass and a partial sum."""
    f = files.withColumn("_low", F.lower("content"))
    return f.groupBy("scan_id").agg(F.count("*").alias("files"), *[F.sum(_threat(i).cast("long")).alias(s[0]) for i, s in enumerate(THREAT_SIGNALS)])


def _threat(i: int) -> Column:
    return holds_any(F.col("_low"), THREAT_WORDS[i]) & F.col("content").rlike(tx.ascii_words(THREAT_SIGNALS[i][2]))


def threat_citations(files: DataFrame, limit: int = 30) -> DataFrame:
    """The first ``limit`` (path, signal) pairs of each scan in path and signal order: a top-k report.

    Each task ranks its own rows first and hands on at most ``limit`` per scan, so a hot scan costs no more.
    """
    hits = F.array_compact(F.array(*[F.when(_threat(i), F.struct(F.lit(i).alias("n"), F.lit(s[1]).alias("signal"))) for i, s in enumerate(THREAT_SIGNALS)]))
    found = files.withColumn("_low", F.lower("content")).select("scan_id", "path", F.explode(hits).alias("h")).select("scan_id", "path", "h.n", "h.signal")
    order = W.partitionBy("scan_id").orderBy("path", "n")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).select("scan_id", "path", "signal")


def product_surface(findings: DataFrame) -> DataFrame:
    """Product surface and boundary state from the location paths."""
    none = F.size("locations") == 0
    outside = F.forall("locations", lambda x: x.file.rlike(NON_PRODUCT.replace("$", r"\z")))
    return findings.withColumn("product_surface", F.when(none, "unknown").when(outside, "test/example/documentation")
                               .otherwise("repository runtime surface requires local confirmation")) \
        .withColumn("boundary_crossed", F.when(~none & outside, F.lit(False)))


# ---- fixed values: text family -> rule --------------------------------------------------------------
RULE_FAMILIES = (
    ("tls-verification-disabled", r"(?:tls|certificate|cwe-295|rejectunauthorized|insecureskipverify)"),
    ("dangerous-dynamic-code", r"(?:eval|dynamic.code|code.injection|cwe-95)"),
    ("shell-command-construction", r"(?:command|shell|process.execution|cwe-78)"),
    ("path-traversal-sink", r"(?:path.traversal|directory.traversal|cwe-22)"),
    ("ssrf-request-sink", r"(?:ssrf|server.side.request|cwe-918)"),
    ("unsafe-deserialization", r"(?:deserial|cwe-502)"),
    ("jwt-verification-disabled", r"(?:jwt|signature.verification|cwe-347)"),
    ("hardcoded-secret-marker", r"(?:credential|hardcoded.secret|cwe-798)"),
    ("sql-injection-query-construction", r"(?:sql.injection|cwe-89)"),
    ("xml-external-entity-risk", r"(?:xml|xxe|cwe-611)"),
    ("cors-wildcard-credentials", r"(?:cors|cwe-942)"),
    ("missing-authorization-route", r"(?:authori[sz]|permission|access.control|cwe-862)"),
)


def compatible_rules(*texts: Column) -> Column:
    """Rule ids whose family the joined lower-case text names."""
    value = F.lower(F.concat_ws("\n", *[F.coalesce(t, F.lit("")) for t in texts]))
    return tx.compact(*[F.when(value.rlike(p), rule) for rule, p in RULE_FAMILIES])


# ---- fixed values: words that put the runtime in scope ------------------------------------------------
_RUNTIME, _SCOPE = r"\b(?:runtime|production|service|api|server)\b", r"\b(?:in scope|supported|security boundary)\b"
RUNTIME_POLICY = rf"(?is){_RUNTIME}.{{0,160}}{_SCOPE}|{_SCOPE}.{{0,160}}{_RUNTIME}"


def runtime_boundary(policies: DataFrame) -> DataFrame:
    """Per scan: does any policy text say that the runtime is in scope?"""
    return policies.groupBy("scan_id").agg(F.bool_or(F.col("content").rlike(tx.ascii_words(RUNTIME_POLICY))).alias("runtime_in_scope"))


def read_range(files: DataFrame, requests: DataFrame, cap: int | None = None) -> DataFrame:
    """Source range per request: an equi-join on scan and path and a slice of the file's lines. A ``cap`` on the lines shows in ``to_line``."""
    keys = [*scan_keys(files, requests), "path"]
    j = requests.join(files.select(*keys, "content"), keys).withColumn("_l", tx.split_lines(F.col("content")))
    start = F.greatest(F.lit(1), F.col("start_line"))
    end = F.greatest(start, F.col("end_line") if cap is None else F.least(start + cap - 1, F.col("end_line")))
    n = F.size("_l")
    return j.select(*requests.columns, start.alias("from_line"), F.least(end, n).alias("to_line"),
                    F.array_join(F.when(start <= n, F.slice("_l", start, end - start + 1)).otherwise(F.array().cast("array<string>")), "\n").alias("text"),
                    tx.sha256(F.col("content")).alias("sha256"))


# ---- fixed values: repository address -----------------------------------------------------------------
GITHUB_REMOTE = r"(?i)^(?:git@github\.com:|ssh://git@github\.com/|https://github\.com/)([^/\s]+)/([^/\s]+?)(?:\.git)?/?\z"
TARGET_PREFIX = "scanlake-target/v1:sha256:"


def target_snapshot(scans: DataFrame) -> DataFrame:
    """Kind, target id and owner/repository from remote, revision and cleanliness. ``scans(scan_id, root,
    remote, revision, dirty)``; a null revision means no version control."""
    remote = F.regexp_replace(tx.trim(F.coalesce("remote", F.lit(""))), r"[?#].*\z", "")
    s = scans.withColumn("_r", remote)
    repo = F.when(F.col("_r").rlike(GITHUB_REMOTE), F.concat_ws("/", F.regexp_extract("_r", GITHUB_REMOTE, 1), F.regexp_extract("_r", GITHUB_REMOTE, 2)))
    s = s.withColumn("source_repository", F.when(F.col("revision").isNotNull() & ~F.col("dirty"), repo))
    kind = F.when(F.col("revision").isNull(), "directory_snapshot").when(F.col("source_repository").isNotNull(), "git_revision").otherwise("git_worktree")
    seed = F.when(F.col("revision").isNull(), F.col("root")).otherwise(F.coalesce("source_repository", F.when(F.col("_r") != "", F.col("_r")), "root"))
    return s.select("scan_id", kind.alias("kind"), F.concat(F.lit(TARGET_PREFIX), tx.sha256(seed)).alias("target_id"),
                    "source_repository", "revision", F.coalesce(F.nullif(tx.basename(F.col("root")), F.lit("")), "root").alias("display_name"))


# ---- fixed values: interface words and compiled languages --------------------------------------------
INTERFACE_PATH = r"(?i)(?:route|handler|controller|api|server|cli|command|parser|plugin)"
INTERFACE_TEXT = r"(?i)(?:request|route|handler|http|cli|parser|plugin)"
COMPILED = ("c", "cpp", "rust", "go", "java", "csharp")


def validation_strategies(findings: DataFrame, preflight: DataFrame) -> DataFrame:
    """Five methods with their status per candidate. ``preflight(scan_id, languages, commands)``."""
    j = findings.join(preflight, "scan_id", "left")
    reachable = F.exists("locations", lambda x: x.file.rlike(INTERFACE_PATH)) | F.concat_ws("\n", "root_cause", "validation").rlike(INTERFACE_TEXT)
    compiled = F.arrays_overlap(F.coalesce("languages", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in COMPILED]))
    setup = lambda cond: F.when(cond, "requires_explicit_setup").otherwise("not_applicable")
    row = lambda method, status: F.struct(F.lit(method).alias("method"), status.alias("status"))
    options = F.array(
        row("isolated_project_checks", F.when(F.size(F.coalesce("commands", F.array().cast("array<string>"))) > 0, "runnable_with_approval").otherwise("not_applicable")),
        row("realistic_interface_reproduction", setup(reachable)), row("debugger_trace", setup(compiled)),
        row("sanitizer_or_memory_checker", setup(compiled)), row("source_trace", F.lit("available_without_execution")))
    return j.select("scan_id", "candidate_id", F.explode(options).alias("s")).select("scan_id", "candidate_id", "s.method", "s.status")
