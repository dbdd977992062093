"""Pattern scans: rules over lines, context evidence, receipts, credentials, searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.flow_rules import SCRIPT_PLACEHOLDER
from ..functions.rules import (CONFIGURATION_RULES, PLACEHOLDER_VALUE, REPLACED_BY_FLOW, SECRET_FIELD,
                               STANDARD_PASSES, TEXT_RULES, REMOVED_CONTROL_RULES, Rule)

EVIDENCE = ("struct<kind:string,detail:string,location:struct<file:string,line:int,excerpt:string,role:string>>")
CONTEXT_NOTE = "Nearby source contains a request/input marker; reachability still requires review."


def location(file, line, excerpt, role: str) -> Column:
    return F.struct(F.col(file).alias("file") if isinstance(file, str) else file.alias("file"),
                    line.cast("int").alias("line"), excerpt.alias("excerpt"), F.lit(role).alias("role"))


def evidence(kind: str, detail: Column, loc: Column | None = None) -> Column:
    place = loc if loc is not None else F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), place.alias("location")).cast(EVIDENCE)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per numbered line; trailing empty lines are kept.

    ``posexplode`` would have Spark test the size of the array before, which splits every text a second time.
    """
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode_outer(tx.split_lines(F.col("content"))).alias("pos", "text")).filter("pos is not null") \
        .select(*keep, (F.col("pos") + 1).alias("line"), "text")


def _applies(rule: Rule, language: Column, replaced: Mapping[str, Sequence[str]]) -> Column:
    """False where a flow job replaces the rule, or the rule is for other languages."""
    off = [lang for lang, ids in replaced.items() if rule.rule_id in ids]
    ok = ~language.isin(off) if off else F.lit(True)
    if rule.languages is not None:
        ok = ok & (language.isin(list(rule.languages)) if rule.languages else F.lit(False))
    return ok


def scan_files(files: DataFrame, rules: Sequence[Rule] = TEXT_RULES,
               passes: Mapping[str, Sequence[str] | None] = STANDARD_PASSES,
               replaced: Mapping[str, Sequence[str]] = REPLACED_BY_FLOW, around: int = 3) -> DataFrame:
    """Every enabled rule over every line, with context evidence from lines -around..+around.

    Map-only: rules become literal patterns, the context slice is cut from the file's own
    line array and only for lines that hit, so no line is ever shuffled.
    """
    language = F.col("language")
    live = [r for r in rules if r.languages is None or r.languages]
    any_rule = "|".join(f"(?:{tx.ascii_words(r.pattern)})" for r in live)
    src = files.withColumn("language", tx.classify_language(F.col("path"))) \
        .withColumn("_lines", tx.split_lines(F.col("content")))
    picked = F.filter(F.transform("_lines", lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
                      lambda x: x.t.rlike(any_rule))
    near = F.transform(picked, lambda x: F.struct(
        (x.i + 1).alias("line"), x.t.alias("text"),
        F.array_join(F.slice(F.col("_lines"), F.greatest(x.i + 1 - around, F.lit(1)),
                             F.least(x.i, F.lit(around)) + around + 1), "\n").alias("near")))
    hits = src.select("scan_id", F.col("path").alias("file"), "language", F.explode(near).alias("h")) \
        .select("scan_id", "file", "language", "h.*")
    shown = tx.excerpt(F.col("text"))
    found = []
    for r_no, rule in enumerate(live):
        marked = F.col("near").rlike(tx.ascii_words(rule.context)) if rule.context else F.lit(False)
        for p_no, (scan_pass, only) in enumerate(passes.items()):
            if only is not None and rule.rule_id not in only:
                continue
            found.append(F.when(
                F.col("text").rlike(tx.ascii_words(rule.pattern)) & _applies(rule, language, replaced),
                F.struct(F.lit(rule.rule_id).alias("rule"), F.lit(rule.severity).alias("severity"),
                         F.lit(rule.cwe).alias("cwe"), F.lit(rule.rationale).alias("rationale"),
                         F.lit(scan_pass).alias("scan_pass"), F.lit(p_no * 1000 + r_no).alias("ord"),
                         marked.alias("in_context"))))
    out = hits.withColumn("excerpt", shown).withColumn("m", F.explode(F.array_compact(F.array(*found))))
    pattern_note = F.concat(F.col("m.scan_pass"), F.lit(" matched "), F.col("m.rule"), F.lit("."))
    notes = F.array(evidence("pattern", pattern_note, location("file", F.col("line"), F.col("excerpt"), "root_control")))
    notes = F.when(F.col("m.in_context"), F.concat(notes, F.array(evidence("context", F.lit(CONTEXT_NOTE))))).otherwise(notes)
    return out.select("scan_id", "m.rule", "m.severity", "file", F.col("line").cast("int").alias("line"),
                      "excerpt", "m.rationale", "m.cwe", notes.alias("evidence"), "m.ord", "m.scan_pass", "m.in_context")


def rule_scan(lines: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Rules over an exploded line table: one literal pattern per rule, one output row per match."""
    found = [F.when(F.col(text).rlike(tx.ascii_words(r.pattern)),
                    F.struct(F.lit(i).alias("rule_no"), F.lit(r.rule_id).alias("rule"), F.lit(r.cwe).alias("cwe"),
                             F.lit(r.severity).alias("severity"), F.lit(r.rationale).alias("rationale")))
             for i, r in enumerate(rules)]
    any_rule = "|".join(f"(?:{tx.ascii_words(r.pattern)})" for r in rules)
    return lines.filter(F.col(text).rlike(any_rule)) \
        .withColumn("_m", F.explode(F.array_compact(F.array(*found)))).select(*lines.columns, "_m.*")


def prune_rules(languages: DataFrame, rules: Sequence[Rule] = TEXT_RULES,
                replaced: Mapping[str, Sequence[str]] = REPLACED_BY_FLOW) -> DataFrame:
    """(language, rule, state): on, replaced (zero receipt) or off (no receipt)."""
    language = F.col("language")
    states = []
    for r in rules:
        off = [lang for lang, ids in replaced.items() if r.rule_id in ids]
        state = F.when(language.isin(off), "replaced") if off else F.when(F.lit(False), "")
        if r.languages is not None:
            other = ~language.isin(list(r.languages)) if r.languages else F.lit(True)
            state = state.when(other, "off")
        states.append(F.struct(F.lit(r.rule_id).alias("rule"), state.otherwise("on").alias("state")))
    return languages.select("*", F.explode(F.array(*states)).alias("_s")).select(*languages.columns, "_s.*")


def rule_receipts(files: DataFrame, matches: DataFrame, rules: Sequence[Rule] = TEXT_RULES,
                  passes: Mapping[str, Sequence[str] | None] = STANDARD_PASSES) -> DataFrame:
    """Matches per (scan, pass, rule), zero included. Counted before any join, so a hot rule is one partial sum."""
    langs = files.select("scan_id", tx.classify_language(F.col("path")).alias("language")).distinct()
    plan = prune_rules(langs, rules).filter("state <> 'off'").select("scan_id", "rule").distinct()
    scope = F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(True) if only is None else F.col("rule").isin(list(only))).alias("on"))
                      for p, only in passes.items()])
    plan = plan.withColumn("_p", F.explode(scope)).filter("_p.on").select("scan_id", F.col("_p.p").alias("scan_pass"), "rule")
    counts = matches.groupBy("scan_id", "scan_pass", "rule").agg(F.count("*").alias("n"))
    return plan.join(counts, ["scan_id", "scan_pass", "rule"], "left") \
        .select("scan_id", "scan_pass", "rule", F.coalesce("n", F.lit(0)).alias("matches"))


# ---- embedded credentials ---------------------------------------------------------------
# Two alternatives (double and single quoted) instead of a back reference, with possessive
# loops so that a long literal cannot exhaust the regex stack. An escaped quote never closes.
# A name is read from its first letter and never given back, so a long word is read once, not once per letter.
_ASSIGN = tx.ascii_words(r"""(?s)(?<![A-Za-z_$])(?=[A-Za-z_$])(?:\b[A-Za-z_$][\w$]*+\s*+\.\s*+)?\$?([A-Za-z_$][\w$]*+)\s*+(?::=|=|:)\s*+"""
           r"""(?:"((?:[^"\\]++|\\.)*+)"|'((?:[^'\\]++|\\.)*+)')""")


# In script languages the literal must be the whole value: nothing but an end may follow it.
_SCRIPT_ASSIGN = _ASSIGN + r"(?=\s*(?:[;,)}\]\r\n]|//|\z))"


def embedded_credentials(files: DataFrame, script: bool = False) -> DataFrame:
    """Credential-named field assigned a literal of 8+ characters that is no placeholder.

    The pattern runs on the whole text, since a literal may span lines. The line of match k is
    one more than the line breaks in the k+1 pieces and the k matches before it. The script
    form (line facts, no syntax tree) takes the literal as written and has its own placeholders.
    """
    content = F.col("content")
    assign = _SCRIPT_ASSIGN if script else _ASSIGN
    breaks = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    pieces = F.arrays_zip(F.transform(F.split(content, assign, -1), breaks).alias("gap"), F.regexp_extract_all(content, F.lit(assign), 0).alias("hit"))
    # running line: fold over the (gap, match) pairs of one file
    spots = F.aggregate(
        pieces, F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,hit:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc.line + x.gap + F.coalesce(breaks(x.hit), F.lit(0))).alias("line"),
            F.when(F.regexp_extract(x.hit, _ASSIGN, 1).rlike(SECRET_FIELD),
                   F.concat(acc.out, F.array(F.struct((acc.line + x.gap).alias("line"), x.hit.alias("hit")))))
            .otherwise(acc.out).alias("out")),
        lambda acc: acc.out)

    def shown(lines, m):
        raw = F.concat(F.regexp_extract(m.hit, _ASSIGN, 2), F.regexp_extract(m.hit, _ASSIGN, 3))
        value = raw if script else tx.trim(F.regexp_replace(raw, r"""\\(?:[\\'"nrt])""", ""))
        return F.struct(m.line.alias("line"), tx.source_line(lines, m.line).alias("excerpt"), F.regexp_extract(m.hit, _ASSIGN, 1).alias("field"), value.alias("value"))
    real = lambda h: ~h.excerpt.rlike(r"^\s*(?://|#|/\*|\*)") & (F.length(h.value) >= 8) & ~h.value.rlike(SCRIPT_PLACEHOLDER if script else PLACEHOLDER_VALUE)
    # all within one expression over the file's lines, and an outer explode: Spark would test a plain one, or a filter after it, by working it out again
    found = F.transform(F.array(tx.split_lines(content)), lambda lines: F.filter(F.transform(spots, lambda m: shown(lines, m)), real))[0]
    hits = files.filter(content.rlike(SECRET_FIELD)).select("scan_id", F.col("path").alias("file"), F.explode_outer(found).alias("h")) \
        .filter("h is not null").select("scan_id", "file", "h.*")
    rule = CONFIGURATION_RULES["secret"]
    place = lambda role: location("file", F.col("line"), F.col("excerpt"), role)
    size = F.length("value").cast("string")
    if script:
        notes = F.array(
            evidence("pattern", F.concat(F.lit("A string literal is assigned to credential field "), "field", F.lit(".")), place("sink")),
            evidence("context", F.concat(F.lit("The embedded literal is "), size, F.lit(" characters and does not match a recognized placeholder form.")), place("root_control")))
    else:
        notes = F.array(
            evidence("pattern", F.concat(F.lit("Configuration analysis found a "), F.col("field"),
                                         F.lit(" field assigned a non-placeholder embedded credential literal.")), place("root_control")),
            evidence("context", F.concat(F.lit("The embedded literal is "), size,
                                         F.lit(" characters; no environment or secret-manager reference is present in this assignment.")), place("sink")))
    return hits.select("scan_id", F.lit(rule.rule_id).alias("rule"), F.lit(rule.severity).alias("severity"), "file",
                       F.col("line").cast("int").alias("line"), "excerpt", F.lit(rule.rationale).alias("rationale"),
                       F.lit(rule.cwe).alias("cwe"), notes.alias("evidence"), F.lit(100).alias("ord"), "field", "value")


def corpus_search(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Case-insensitive search: (path, line, first 300 characters), first ``limit`` by path and line.

    The limit is the feature (a top-k report); Spark keeps k rows per task (TakeOrdered).
    """
    lines = explode_lines(files.select("path", "content"))
    return lines.filter(F.col("text").rlike(f"(?i){pattern}")) \
        .select("path", "line", F.substring("text", 1, 300).alias("text")) \
        .orderBy("path", "line").limit(limit)


def removed_controls(diff_lines: DataFrame, rules: Sequence[Rule] = REMOVED_CONTROL_RULES) -> DataFrame:
    """Deleted lines that held a control; the first rule in order wins."""
    chosen = F.coalesce(*[F.when(F.col("text").rlike(tx.ascii_words(r.pattern)), F.struct(
        F.lit(r.rule_id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.cwe).alias("cwe"),
        F.lit(r.rationale).alias("rationale"))) for r in rules])
    out = diff_lines.filter("side = '-'").withColumn("m", chosen).filter("m is not null") \
        .withColumn("excerpt", tx.excerpt(F.col("text"))).withColumn("line", F.col("old_line").cast("int"))
    place = location("file", F.col("line"), F.col("excerpt"), "expected_control")
    notes = F.array(
        evidence("pattern", F.concat(F.lit("Diff removal matched "), F.col("m.rule"), F.lit(".")), place),
        evidence("counterevidence", F.lit("The changed hunk removes an explicit security control; no equivalent replacement is established by this diff-only analysis."), place))
    return out.select("scan_id", "m.rule", "m.severity", "file", "line", "excerpt", "m.rationale", "m.cwe",
                      notes.alias("evidence"), F.lit(500).alias("ord"))
