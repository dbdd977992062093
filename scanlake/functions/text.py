"""Column expressions for paths, lines, excerpts, slugs, severities and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# ---- fixed values: file extension -> language -------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go", ".java": "java",
    ".php": "php", ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".bash": "shell",
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp",
}
# ---- fixed values: severity order ---------------------------------------------------
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1, "ignore": 0}
# ---- fixed values: category label per rule prefix ----------------------------------
TAXONOMY_LABELS = {
    "sql-injection": "SQL injection",
    "path-traversal": "Path traversal",
    "ssrf": "Server-side request forgery",
    "shell-command": "Command injection",
    "command-injection": "Command injection",
    "dynamic-code": "Code injection / dynamic evaluation",
    "unsafe-deserialization": "Insecure deserialization",
    "tls-verification": "TLS certificate verification disabled",
    "jwt-verification": "JWT signature verification disabled",
    "cors": "Credentialed CORS misconfiguration",
    "xml": "XML external entity risk",
    "authorization": "Authorization bypass",
    "authentication": "Authentication bypass",
    "weak-randomness": "Weak cryptographic randomness",
    "embedded-credential": "Hardcoded credentials",
    "prototype-pollution": "Prototype pollution",
    "removed-authorization": "Removed authorization control",
    "removed-input-validation": "Removed input-validation control",
    "ci": "CI/CD trust-boundary risk",
}
# ---- fixed values: the white space a JavaScript-style trim removes ------------------
BLANK = r"[\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_words(pattern: str) -> str:
    """``\\b`` between ASCII word characters only, whatever the JVM's own word rule is.

    Each edge becomes one assertion that looks to both sides; where a literal word character follows, the side behind it
    says it all.
    """
    def edge(m: re.Match) -> str:
        if m[0] != r"\b":
            return m[0]
        rest = pattern[m.end():m.end() + 2]
        opens = re.match(r"[A-Za-z0-9_](?![?*{])", rest)
        return f"(?<!{_WORD})" if opens else _EDGE

    return re.sub(r"\\.", edge, pattern, flags=re.DOTALL)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Literal-map lookup kept inside codegen."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def basename(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name, lower or upper case kept; '' for dot files."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def classify_language(path: Column) -> Column:
    return lookup(LANGUAGE_BY_EXTENSION, extension(path), "text")


def is_binary(content: Column) -> Column:
    return F.contains(content, F.lit("\0"))


#: The characters of ``BLANK``, one by one.
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trim(text: Column) -> Column:
    """Without white space at both ends; looks at the ends alone, where a pattern would be tried at every character."""
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, rf"{BLANK}+", " ")


def excerpt(text: Column) -> Column:
    """Trimmed line, first 240 characters (code points)."""
    return F.substring(trim(text), 1, 240)


def split_lines(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def line_at(content: Column, offset: Column) -> Column:
    """1-based line that holds the 0-based character offset."""
    return F.size(F.split(F.substring(content, F.lit(1), offset), r"\r?\n", -1))


def source_line(lines: Column, number: Column) -> Column:
    """Excerpt of a 1-based line of a line array; '' outside the file."""
    return F.coalesce(excerpt(F.get(lines, number - 1)), F.lit(""))


def slug(text: Column, limit: int | None = 180) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    if limit:
        dashed = F.substring(dashed, 1, limit)
    return F.when(dashed == "", "root-control").otherwise(dashed)


def rest(text: Column, start: int) -> Column:
    """Everything from a character on (counted from 1)."""
    return F.substring(text, start, 2**31 - 1)


def taxonomy(rule_id: Column) -> Column:
    """Label of the part before the first dot; otherwise that part in words, capitalised."""
    key = F.replace(F.split(rule_id, r"\.")[0], F.lit("."), F.lit("-"))
    words = F.replace(key, F.lit("-"), F.lit(" "))
    spoken = F.concat(F.upper(F.substring(words, 1, 1)), rest(words, 2))
    return F.coalesce(lookup(TAXONOMY_LABELS, key), spoken)


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, severity)


def compact(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(*parts: Column | str) -> Column:
    """Parts joined by ':'; nulls count as empty text."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(":", *cols)


def candidate_id(scan_id: Column, rule: Column, file: Column, line: Column) -> Column:
    """128 bits over scan, rule and place, so that neither two scans nor chance make two candidates one."""
    return F.concat(F.lit("cand_"), F.substring(sha256(joined(scan_id, rule, file, line)), 1, 32))


def finding_fingerprint(target: Column, rule: Column, anchor: Column, instance: Column) -> Column:
    return sha256(joined(target, rule, anchor, instance))


def finding_id(target: Column, rule: Column, anchor: Column, instance: Column) -> Column:
    return F.concat(F.lit("slf_"), F.substring(sha256(joined(target, rule, anchor, instance)), 1, 24))


def occurrence_id(scan_id: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("occ_"), F.substring(sha256(joined(scan_id, fingerprint)), 1, 24))
