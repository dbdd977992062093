"""Unified diffs as tables: numbered lines, receipts, added-line anchoring, bounded input, scan rows.

Two differences from a plain line loop are deliberate. A ``\\ No newline`` marker moves no
counter, and a ``---`` or ``+++`` line is a header only outside the extent its hunk declares,
so deleted lines that begin with dashes stay deleted lines of their own file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.rules import REPLACED_BY_FLOW, TEXT_RULES, Rule
from .patterns import CONTEXT_NOTE, _applies, evidence, location

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
MAX_BYTES = 1_000_000


def diff_path(path: Column) -> Column:
    bad = (path == "") | (path == "/dev/null") | F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    return F.when(bad, "unknown").otherwise(path)


def parse_diffs(patches: DataFrame) -> DataFrame:
    """``patches(scan_id, patch_id, patch)`` to (file, side, old_line, new_line, text, hunk).

    Windows are per patch and per hunk, and a patch is one cell.
    """
    ln = patches.select("scan_id", "patch_id", F.posexplode(F.split("patch", r"\r?\n", -1)).alias("pos", "raw"))
    order = W.partitionBy("scan_id", "patch_id").orderBy("pos")
    up_to = order.rowsBetween(W.unboundedPreceding, 0)
    head = F.col("raw").rlike(HUNK)
    num = lambda i, default: F.when(head, F.coalesce(F.regexp_extract("raw", HUNK, i).try_cast("int"), F.lit(default)))
    ln = ln.withColumn("head", head).withColumn("hunk", F.sum(head.cast("int")).over(up_to))
    for name, i, default in (("old0", 1, 0), ("n_old", 2, 1), ("new0", 3, 0), ("n_new", 4, 1)):
        ln = ln.withColumn(name, F.last(num(i, default), ignorenulls=True).over(up_to))
    first = F.substring("raw", 1, 1)
    # the text after the last line break is no line of the patch
    last_pos = F.max("pos").over(W.partitionBy("scan_id", "patch_id"))
    ln = ln.withColumn("_tail", (F.col("pos") == last_pos) & (F.col("raw") == ""))
    side = F.when(F.col("head") | F.col("_tail") | (F.col("hunk") == 0) | (first == "\\"), None).when(first == "+", "+").when(first == "-", "-").when((first == " ") | (F.col("raw") == ""), " ")
    ln = ln.withColumn("side", side)
    before = W.partitionBy("scan_id", "patch_id", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda sides: F.coalesce(F.sum(F.col("side").isin(sides).cast("int")).over(before), F.lit(0))
    ln = ln.withColumn("_o", seen(["-", " "])).withColumn("_n", seen(["+", " "]))
    ln = ln.withColumn("inside", F.col("side").isNotNull() & ((F.col("_o") < F.col("n_old")) | (F.col("_n") < F.col("n_new"))))
    raw = F.col("raw")
    name = F.when(~F.col("inside") & raw.rlike(r"^\+\+\+ b/"), tx.rest(raw, 7)) \
        .when(~F.col("inside") & raw.rlike(r"^\+\+\+ /dev/null"), F.lag(F.regexp_extract("raw", r"^--- a/(.*)\z", 1)).over(order))
    ln = ln.withColumn("file", F.last(diff_path(name), ignorenulls=True).over(up_to))
    return ln.filter("inside").select(
        "scan_id", "patch_id", "hunk", "pos", F.coalesce("file", F.lit("unknown")).alias("file"), "side",
        (F.col("old0") + F.col("_o")).alias("old_line"), (F.col("new0") + F.col("_n")).alias("new_line"),
        F.when(F.col("raw") == "", "").otherwise(tx.rest(raw, 2)).alias("text"))


def added_lines(diff_lines: DataFrame) -> DataFrame:
    return diff_lines.filter("side = '+' and file <> 'unknown'").select("scan_id", F.col("file").alias("path"), F.col("new_line").alias("line")).distinct()


def scan_added(diff_lines: DataFrame, rules: Sequence[Rule] = TEXT_RULES, around: int = 3) -> DataFrame:
    """Rules over added lines; context is the added lines of the same hunk around the hit."""
    live = [r for r in rules if r.languages is None or r.languages]
    near = W.partitionBy("scan_id", "patch_id", "hunk").orderBy("pos").rowsBetween(-around, around)
    plus = diff_lines.filter("side = '+'").withColumn("near", F.concat_ws("\n", F.collect_list("text").over(near)))
    language = tx.classify_language(F.col("file"))
    found = []
    for i, r in enumerate(live):
        marked = F.col("near").rlike(tx.ascii_words(r.context)) if r.context else F.lit(False)
        found.append(F.when(F.col("text").rlike(tx.ascii_words(r.pattern)) & _applies(r, language, REPLACED_BY_FLOW), F.struct(
            F.lit(r.rule_id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.cwe).alias("cwe"), F.lit(r.rationale).alias("rationale"),
            F.lit(i).alias("ord"), marked.alias("in_context"))))
    out = plus.withColumn("m", F.explode(F.array_compact(F.array(*found)))).withColumn("excerpt", tx.excerpt(F.col("text")))
    place = location("file", F.col("new_line"), F.col("excerpt"), "root_control")
    own = F.array(evidence("pattern", F.concat(F.lit("diff-added matched "), F.col("m.rule"), F.lit(".")), place))
    notes = F.when(F.col("m.in_context"), F.concat(own, F.array(evidence("context", F.lit(CONTEXT_NOTE))))).otherwise(own)
    return out.select("scan_id", "m.rule", "m.severity", "file", F.col("new_line").alias("line"), "excerpt", "m.rationale", "m.cwe", notes.alias("evidence"), "m.ord")


def touching_added(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """Candidates whose own line or any evidence location is an added line: one left-semi join on (file, line)."""
    c = candidates.withColumn("_id", tx.sha256(F.to_json(F.struct("rule", "file", "line", "excerpt", "evidence"))))
    own = F.array(F.struct(F.col("file").alias("file"), F.col("line").cast("int").alias("line")))
    more = F.transform(F.filter("evidence", lambda e: e.location.isNotNull()), lambda e: F.struct(e.location.file.alias("file"), e.location.line.alias("line")))
    spots = c.select("scan_id", "_id", F.explode(F.array_distinct(F.concat(own, more))).alias("s")).select("scan_id", "_id", F.col("s.file").alias("path"), F.col("s.line").alias("line"))
    hit = spots.join(added, ["scan_id", "path", "line"], "left_semi").select("scan_id", "_id").distinct()
    return c.join(hit, ["scan_id", "_id"], "left_semi").drop("_id")


def diff_receipts(patches: DataFrame) -> DataFrame:
    """Bytes, digest and language of each changed file's own section: map-only, cut at the file headers."""
    cut = F.split("patch", r"(?m)^diff --git ", -1)
    s = patches.select("scan_id", F.explode(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))).alias("section"))
    s = s.withColumn("path", diff_path(F.regexp_extract("section", r"^a/.* b/(.*)", 1))).withColumn("body", F.regexp_replace("section", r"^[^\n]*", ""))
    changed = s.filter((F.col("path") != "unknown") & F.col("body").rlike(r"(?m)^(?:\+(?!\+\+)|-(?!--))"))
    return changed.select("scan_id", "path", F.octet_length("body").cast("long").alias("bytes"), tx.sha256(F.col("body")).alias("sha256"), tx.classify_language(F.col("path")).alias("language"))


def cap_patches(patches: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Flag patches beyond the size a review may cover in full; the patch itself stays whole, the flag lowers completeness downstream."""
    return patches.withColumn("truncated", F.octet_length("patch") > max_bytes)


def diff_scan_rows(requests: DataFrame) -> DataFrame:
    """Effective mode, base, head, completeness and preflight status per diff scan.

    ``requests(scan_id, requested_mode, base, head, parent, truncated)``.
    """
    mode = F.when(F.col("requested_mode") == "auto", F.when(F.col("base").isNotNull(), "branch_diff").otherwise("working_tree")).otherwise(F.col("requested_mode"))
    r = requests.withColumn("mode", mode)
    error = F.when(F.col("mode").isin("commit", "branch_diff") & F.col("base").isNull(), "base required") \
        .when((F.col("mode") == "working_tree") & F.col("base").isNotNull(), "working tree takes no base") \
        .when(~F.col("base").rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*\z"), "base ref not supported")
    r = r.withColumn("error", error)
    return r.select("scan_id", "mode", "error", F.when(F.col("mode") == "commit", F.col("parent")).when(F.col("mode") == "branch_diff", F.col("base")).otherwise(F.col("head")).alias("base_revision"),
                    F.when(F.col("mode") == "commit", F.col("base")).otherwise(F.col("head")).alias("head_revision"),
                    (~F.col("truncated")).alias("complete"), F.when(F.col("truncated"), "warn").otherwise("ready").alias("status"))
