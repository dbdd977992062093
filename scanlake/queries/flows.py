"""Pairing, workflow, diff and taint jobs over source text that Spark writes from the line items.

One file per order, one statement (or block) per line item; the columns of the line item decide
which shape it takes. The SQL twin never parses text: it predicts findings from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diffs as df, graph, pairing as pr, patterns as pt, taint as tt, workflows as wf
from ..plans import views as v
from ..scale import written
from .registry import query

F_, S_ = "l_returnflag", "l_linestatus"


def _when(*cases):
    """CASE over (flag+status prefix, Spark text); shared by the file builder."""
    out = None
    for test, text in cases:
        cond = F.concat(F.col(F_), F.col(S_)).rlike(f"^{test}")
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def _name(prefix: str):
    return F.concat_ws("_", F.lit(prefix), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string"))


def _placed(counts: dict[str, int], head: int = 0) -> str:
    """CTE ``placed``: each statement with its first line, from lines per flag+status."""
    nl = "case " + " ".join(f"when {F_} || {S_} like '{k}%' then {n}" for k, n in counts.items()) + " end"
    return f"""{v.NUMBERED_SQL},
placed as (select *, 'src/f' || l_orderkey as file, {F_} || {S_} as fs, {nl} as nl, {head} + 1 + coalesce(sum({nl}) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding), 0) as start from numbered)"""


def _found(candidates):
    return candidates.select("rule", "file", "line")


# ---- call options and chains ---------------------------------------------------------------------------
@query("jwt_disabled", f"""
with {_placed({'RO': 2, 'R': 1, 'A': 1, 'N': 1})}
select 'jwt-verification-disabled' as rule, file || '.py' as file, start as line from placed where fs in ('RO', 'AO', 'NO') group by all""")
def jwt_disabled(spark, sf):
    name = _name("o")
    stmt = _when(("RO", F.concat(name, F.lit(' = {"verify_signature": False}\nclaims = jwt.decode(token, key, options='), name, F.lit(")"))), ("RF", F.concat(name, F.lit(' = {"verify_signature": False}'))),
                 ("AO", F.lit("claims = jwt.decode(token, key, verify=False)")), ("AF", F.lit("claims = jwt.decode(token, key, verify=True)")),
                 ("NO", F.lit('claims = jwt.decode(token, algorithms=["none"])')), ("NF", F.lit('claims = jwt.decode(token, algorithms=["RS256"])')))
    return _found(pr.jwt_disabled(v.code_files(spark, sf, ".py", "", stmt)))


@query("tls_disabled_calls", f"""
with {_placed({'RO': 2, 'R': 1, 'A': 1, 'N': 1})}
select 'tls-verification-disabled' as rule, file || '.py' as file, start as line from placed where fs in ('RO', 'AO') group by all""")
def tls_disabled_calls(spark, sf):
    name = _name("o")
    stmt = _when(("RO", F.concat(name, F.lit(' = {"verify": False}\nhttpx.post("https://a.test", **'), name, F.lit(")"))), ("RF", F.concat(name, F.lit(' = {"verify": False}'))),
                 ("AO", F.lit('requests.get("https://a.test", verify=False)')), ("AF", F.lit('client.get("https://a.test", verify=False)')),
                 ("N", F.lit('requests.get("https://a.test", verify=True)')))
    return _found(pr.tls_disabled_calls(v.code_files(spark, sf, ".py", "", stmt)))


@query("construction_chains", f"""
with {_placed({'R': 6, 'A': 6, 'N': 6}, 1)}
select 'tls-verification-disabled' as rule, file || '.go' as file, start + 1 as line from placed where fs = 'RO'""")
def construction_chains(spark, sf):
    def block(skip, bind, use):
        return F.concat(F.lit("func "), _name("f"), F.lit(f"() {{\n cfg := &tls.Config{{InsecureSkipVerify: {skip}}}\n tr := &http.Transport{{{bind}}}\n cl := &http.Client{{Transport: tr}}\n {use}\n}}"))
    bound, get = "TLSClientConfig: cfg", 'cl.Get("https://a.test")'
    stmt = _when(("RO", block("true", bound, get)), ("RF", block("true", "", get)), ("A", block("true", bound, "log.Print(cl)")), ("N", block("false", bound, get)))
    return _found(pr.construction_chain(v.code_files(spark, sf, ".go", "package app", stmt)))


def _handles(ext, init, off, run, head):
    def block(a, b, c):
        return F.concat(F.lit(head), _name("f"), F.lit("() {\n  " + a + "\n  " + b + "\n  " + c + "\n}"))
    return _when(("RO", block(init, off, run)), ("RF", block(init, off, run.replace("hnd", "oth"))), ("A", block("noop();", off, run)), ("N", block(init, "noop();", run)))


HANDLE_SQL = """
with {placed} select 'tls-verification-disabled' as rule, file || '{ext}' as file, start + 2 as line from placed where fs = 'RO'"""


@query("php_handle_lifecycle", HANDLE_SQL.format(placed=_placed({"R": 5, "A": 5, "N": 5}, 1), ext=".php"))
def php_handle_lifecycle(spark, sf):
    stmt = _handles(".php", "$hnd = curl_init();", "curl_setopt($hnd, CURLOPT_SSL_VERIFYPEER, false);", "curl_exec($hnd);", "function ")
    return _found(pr.handle_lifecycle(v.code_files(spark, sf, ".php", "<?php", stmt), "php"))


@query("native_handle_lifecycle", HANDLE_SQL.format(placed=_placed({"R": 5, "A": 5, "N": 5}, 1), ext=".c"))
def native_handle_lifecycle(spark, sf):
    stmt = _handles(".c", "CURL *hnd = curl_easy_init();", "curl_easy_setopt(hnd, CURLOPT_SSL_VERIFYPEER, 0L);", "curl_easy_perform(hnd);", "void ")
    return _found(pr.handle_lifecycle(v.code_files(spark, sf, ".c", "#include <curl.h>", stmt), "native"))


@query("unhardened_parsers", f"""
with {_placed({'R': 5, 'A': 5, 'N': 5}, 1)}
select 'xml-external-entity-risk' as rule, file || '.java' as file, case fs when 'RO' then start + 3 else start + 2 end as line from placed where fs in ('RO', 'AO', 'AF')""")
def unhardened_parsers(spark, sf):
    def block(a, b):
        return F.concat(F.lit(" void "), _name("f"), F.lit("() {\n  DocumentBuilderFactory dbf = DocumentBuilderFactory.newInstance();\n  " + a + "\n  " + b + "\n }"))
    harden, create = 'dbf.setFeature("http://apache.org/xml/features/disallow-doctype-decl", true);', "dbf.newDocumentBuilder();"
    stmt = _when(("RO", block("noop();", create)), ("RF", block(harden, create)), ("A", block(create, harden)), ("N", block(harden, "noop();")))
    return _found(pr.unhardened_use(v.code_files(spark, sf, ".java", "class X {", stmt, "}")))


@query("paired_settings", f"""
with {_placed({'A': 2, 'R': 1, 'N': 1})}
select 'cors-wildcard-credentials' as rule, file || '.ts' as file, start as line from placed where fs in ('RO', 'AO')""")
def paired_settings(spark, sf):
    name = _name("o")
    stmt = _when(("RO", F.lit("cors({ origin: true, credentials: true })")), ("RF", F.lit("cors({ origin: true })")),
                 ("AO", F.concat(F.lit("const "), name, F.lit(" = { origin: '*', credentials: true }\ncors("), name, F.lit(")"))),
                 ("AF", F.concat(F.lit("const "), name, F.lit(" = { origin: '*', credentials: true }\nlog("), name, F.lit(")"))), ("N", F.lit("cors({ origin: ['https://a.test'], credentials: true })")))
    return _found(pr.paired_settings(v.code_files(spark, sf, ".ts", "", stmt)))


@query("config_reaches_call", f"""
with {_placed({'A': 2, 'R': 1, 'N': 1})}
select 'tls-verification-disabled' as rule, file || '.ts' as file, start as line from placed where fs in ('RO', 'AO')""")
def config_reaches_call(spark, sf):
    name = _name("o")
    stmt = _when(("RO", F.lit("request({ rejectUnauthorized: false })")), ("RF", F.lit("fetch('https://a.test', { rejectUnauthorized: false })")),
                 ("AO", F.concat(F.lit("const "), name, F.lit(" = { rejectUnauthorized: false }\nhttps.request('https://a.test', "), name, F.lit(")"))),
                 ("AF", F.concat(F.lit("const "), name, F.lit(" = { rejectUnauthorized: false }\nlog("), name, F.lit(")"))), ("N", F.lit("https.get({ rejectUnauthorized: true })")))
    return _found(pr.config_reaches_call(v.code_files(spark, sf, ".ts", "", stmt)))


# ---- routes -------------------------------------------------------------------------------------------------
@query("unguarded_routes", f"""
with {_placed({'R': 1, 'A': 1, 'N': 1})}, g as (select *, coalesce(sum(case when fs = 'AO' then 1 else 0 end) over (partition by l_orderkey order by n), 0) as guards from placed)
select 'missing-authorization-route' as rule, file || '.ts' as file, start as line from g where (fs in ('RO', 'RF') and guards = 0) or fs = 'NF'""")
def unguarded_routes(spark, sf):
    stmt = _when(("R", F.lit("app.post('/a', createUser)")), ("AO", F.lit("app.use(requireRole)")), ("AF", F.lit("app.use('/p', logAll)")),
                 ("NO", F.lit("app.put('/b', requireAuth, saveUser)")), ("NF", F.lit("other.delete('/c', (req, res) => res.json(1))")))
    return _found(pr.unguarded_routes(v.code_files(spark, sf, ".ts", "", stmt)))


@query("unguarded_python_routes", f"""
with {_placed({'R': 3, 'A': 3, 'N': 3})} select 'missing-authorization-route' as rule, file || '.py' as file, start as line from placed where fs in ('RO', 'AO')""")
def unguarded_python_routes(spark, sf):
    def block(route, params):
        return F.concat(F.lit(f"@app.{route}\ndef "), _name("f"), F.lit(f"({params}):\n    return 1"))
    stmt = _when(("RO", block("post('/a')", "payload")), ("RF", block("post('/a', dependencies=[Depends(require_authorization)])", "payload")), ("AO", block("patch('/b')", "")),
                 ("AF", block("patch('/b')", "user = Depends(require_session)")), ("N", block("get('/c')", "")))
    return _found(pr.unguarded_python_routes(v.code_files(spark, sf, ".py", "", stmt)))


@query("unguarded_java_routes", f"""
with {_placed({'RF': 3, 'R': 2, 'A': 2, 'N': 2}, 1)} select 'missing-authorization-route' as rule, file || '.java' as file, start as line from placed where fs in ('RO', 'AO')""")
def unguarded_java_routes(spark, sf):
    def block(notes):
        return F.concat(F.lit(notes + "\n  public void "), _name("f"), F.lit("() {}"))
    stmt = _when(("RO", block('  @PostMapping("/a")')), ("RF", block("  @PreAuthorize(\"hasRole('X')\")\n  @DeleteMapping(\"/a\")")), ("AO", block('  @RequestMapping(value = "/b", method = RequestMethod.PUT)')),
                 ("AF", block('  @RequestMapping(value = "/b", method = RequestMethod.GET)')), ("N", block('  @GetMapping("/c")')))
    return _found(pr.unguarded_java_routes(v.code_files(spark, sf, ".java", "class X {", stmt, "}")))


@query("guarded_mounts", """
with recursive e as (select c_custkey as src, c_custkey // 3 + c_nationkey as dst from customer),
r as (select c_custkey as node from customer where c_acctbal > 9500 union select e.dst from r join e on e.src = r.node)
select node from r""")
def guarded_mounts(spark, sf):
    """The mount closure as plain reachability: customers above a balance protect what they mount."""
    c = v.table(spark, sf, "customer").withColumn("scan_id", F.lit("all"))
    edges = c.select("scan_id", F.col("c_custkey").alias("src"), (F.floor(F.col("c_custkey") / 3) + F.col("c_nationkey")).alias("dst"))
    return graph.reach(edges, c.filter("c_acctbal > 9500").select("scan_id", F.col("c_custkey").alias("node")), ["scan_id"]).select("node")


# ---- workflows -------------------------------------------------------------------------------------------------
WF_SQL = _placed({"R": 2, "A": 1, "NO": 1, "N": 3}, 5).replace("'src/f' || l_orderkey as file", "'.github/workflows/o' || l_orderkey || '.yml' as file")


def _workflows(spark, sf):
    name = F.concat(F.lit("V"), F.col(S_))
    stmt = _when(("R", F.concat(F.lit('      - run: |\n          echo "'), name, F.lit('=${{ github.event.pull_request.title }}" >> "$GITHUB_ENV"'))), ("A", F.concat(F.lit('      - run: echo "$'), name, F.lit('"'))),
                 ("NO", F.lit("      - uses: actions/setup@main")), ("NF", F.lit("      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}")))
    files = v.code_files(spark, sf, ".yml", "on:\n  pull_request_target:\njobs:\n  j:\n    steps:", stmt)
    return files.withColumn("path", F.concat(F.lit(".github/workflows/o"), "l_orderkey", F.lit(".yml")))


@query("workflow_steps", f"with {WF_SQL} select file, 'j' as job, start as step, start + nl - 1 as end_line from placed")
def workflow_steps(spark, sf):
    return wf.steps_of(wf.workflow_steps(_workflows(spark, sf))).select(F.col("path").alias("file"), "job", "step", "end_line")


@query("workflow_findings", f"""
with {WF_SQL}, w as (select *, l_linestatus as var, min(case when fs like 'R%' then n end) over (partition by l_orderkey, l_linestatus) as first_write,
  max(case when fs like 'R%' or fs like 'A%' then n end) over (partition by l_orderkey) as last_run from placed)
select 'ci-untrusted-event-shell' as rule, file, start as line from w where fs like 'A%' and first_write < n
union all select 'ci-mutable-action-ref', file, start from w where fs = 'NO'
union all select 'ci-pull-request-target-untrusted-checkout', file, start + 2 from w where fs = 'NF' and last_run > n""")
def workflow_findings(spark, sf):
    return _found(wf.workflow_candidates(_workflows(spark, sf))).distinct()


@query("workflow_diff_findings", f"""
with {WF_SQL}, w as (select *, l_linestatus as var, max(case when fs like 'R%' or fs like 'A%' then n end) over (partition by l_orderkey) as last_run from placed),
f as (select a.file, a.start as sink, r.start + 1 as entry from w a join w r on r.l_orderkey = a.l_orderkey and r.var = a.var and r.n < a.n where a.fs like 'A%' and r.fs like 'R%')
select distinct 'ci-untrusted-event-shell' as rule, file, case when sink % 2 = 0 then sink else entry end as line from f where sink % 2 = 0 or entry % 2 = 0
union all select 'ci-mutable-action-ref', file, start from w where fs = 'NO' and start % 2 = 0
union all select distinct * from (select 'ci-pull-request-target-untrusted-checkout', c.file, case when c.start % 2 = 0 then c.start + 2
  else (select min(r.start) from w r where r.l_orderkey = c.l_orderkey and r.n > c.n and (r.fs like 'R%' or r.fs like 'A%') and r.start % 2 = 0) end as line from w c where fs = 'NF' and last_run > n) x where line is not null""")
def workflow_diff_findings(spark, sf):
    """The same files as a diff in which every other line is new: a finding moves to the new line of its path, or goes."""
    files = written(_workflows(spark, sf))  # read for its lines and for the diff
    added = pt.explode_lines(files).filter("line % 2 = 0").select("scan_id", "path", "line")
    return _found(wf.workflow_candidates(files, added)).distinct()


@query("write_permissions", """
with p(seg, line, text) as (values ('BUILDING', 2, 'permissions: write-all'), ('MACHINERY', 3, 'contents: write'), ('HOUSEHOLD', 5, 'issues: write'))
select '.github/workflows/c' || c_custkey || '.yml' as path, line, text from customer join p on seg = c_mktsegment""")
def write_permissions(spark, sf):
    """One workflow per customer; inline, top-level and job-level grants, and files that only read."""
    body = F.when(F.col("c_mktsegment") == "BUILDING", "on: push\npermissions: write-all\njobs:\n  a:\n    steps:") \
        .when(F.col("c_mktsegment") == "MACHINERY", "on: push\npermissions:\n  contents: write\n  issues: read\njobs:\n  a:\n    steps:") \
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "on: push\njobs:\n  a:\n    permissions:\n      issues: write\n    steps:") \
        .otherwise("on: push\npermissions:\n  contents: read\njobs:\n  write:\n    steps:")
    files = v.table(spark, sf, "customer").select(F.lit("s").alias("scan_id"), F.concat(F.lit(".github/workflows/c"), "c_custkey", F.lit(".yml")).alias("path"), body.alias("content"))
    return wf.write_permissions(wf.workflow_lines(files)).select("path", "line", "text")


@query("earlier_step_flows", """
with t as (select conv_id, turn, role, length(text) as k from conversations), w as (select conv_id, turn, role as name, k from t where k > 200), r as (select conv_id, turn, role as name from t)
select r.conv_id, r.turn as step, w.turn as write_step from r join w on w.conv_id = r.conv_id and w.name = r.name and w.turn < r.turn""")
def earlier_step_flows(spark, sf):
    c = v.table(spark, sf, "conversations").select(F.lit("s").alias("scan_id"), F.col("conv_id").alias("path"), F.lit("j").alias("job"), "turn", F.col("role").alias("name"), F.length("text").alias("k"))
    writes = c.select("scan_id", "path", "job", F.col("turn").alias("write_step"), F.when(F.col("k") > 200, F.col("name")).otherwise(F.lit("other")).alias("name"), F.col("turn").alias("line"), F.lit("").alias("text"))
    out = wf.earlier_step_flows(c.withColumnRenamed("turn", "step").drop("k"), writes)
    return out.select(F.col("path").alias("conv_id"), "step", "write_step")


# ---- diffs ------------------------------------------------------------------------------------------------------
SIDE = "case when length(l) % 3 = 0 then '+' when length(l) % 3 = 1 then '-' else ' ' end"
PATCH_SQL = f"""ls as (select doc_id, source || '/' || doc_id || '.sh' as file, unnest(string_split_regex(text, '\\r?\\n')) as l, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) as i from documents),
sd as (select *, {SIDE} as side from ls),
dl as (select *, 10 + coalesce(sum(case when side <> '+' then 1 else 0 end) over w, 0) as old_line, 20 + coalesce(sum(case when side <> '-' then 1 else 0 end) over w, 0) as new_line
  from sd window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding))"""


def _patches(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("file", F.concat("source", F.lit("/"), "doc_id", F.lit(".sh")))
    side = lambda l: F.when(F.length(l) % 3 == 0, "+").when(F.length(l) % 3 == 1, "-").otherwise(" ")
    body = F.transform(tx.split_lines(F.col("text")), lambda l: F.concat(side(l), l))
    d = d.withColumn("body", body)
    count = lambda out: F.size(F.filter("body", lambda b: ~F.startswith(b, F.lit(out)))).cast("string")
    head = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -10,"), count("+"), F.lit(" +20,"), count("-"), F.lit(" @@\n"))
    return d.select(F.col("source").alias("scan_id"), F.col("doc_id").alias("patch_id"), F.concat(head, F.array_join("body", "\n"), F.lit("\n")).alias("patch"))


@query("diff_lines", f"with {PATCH_SQL} select file, side, old_line, new_line, l as text from dl")
def diff_lines(spark, sf):
    return df.parse_diffs(_patches(spark, sf)).select("file", "side", "old_line", "new_line", "text")


@query("added_line_scan", f"""
with {PATCH_SQL}, p as (select *, string_agg(l, chr(10)) over (partition by doc_id order by i rows between 3 preceding and 3 following) as near from dl where side = '+')
select file, new_line as line, 'long-number' as rule, regexp_matches(near, '(?i)id|key|phone') as in_context from p where regexp_matches(l, '[0-9]{{6,}}')""")
def added_line_scan(spark, sf):
    from .core import PROSE_RULES
    found = df.scan_added(df.parse_diffs(_patches(spark, sf)), [r for r in PROSE_RULES if r.rule_id == "long-number"])
    return found.select("file", "line", "rule", F.exists("evidence", lambda e: e.kind == "context").alias("in_context"))


@query("removed_controls", f"""
with {PATCH_SQL}, r(n, rule, pattern) as (values (1, 'contact', '(?i)@|http'), (2, 'article', '(?i)\\bthe\\b|\\bun\\b|\\bla\\b'))
select file, old_line as line, arg_min(rule, n) as rule from dl join r on regexp_matches(l, pattern) where side = '-' group by file, old_line""")
def removed_controls(spark, sf):
    from ..functions.rules import Rule
    rules = (Rule("contact", "CWE-1", "low", "x", r"(?i)@|http"), Rule("article", "CWE-2", "low", "x", r"(?i)\bthe\b|\bun\b|\bla\b"))
    return pt.removed_controls(df.parse_diffs(_patches(spark, sf)), rules).select("file", "line", "rule")


@query("touching_added", f"""
with {PATCH_SQL}, a as (select distinct file, new_line from dl where side = '+'), c as (select event_id, user_id, cast(floor(value) as int) + 20 as line, cast(floor(value) as int) + 25 as other from events),
f as (select event_id, file, line, other from c join (select distinct doc_id, file from ls) d on d.doc_id = user_id)
select event_id from f where (file, line) in (select file, new_line from a) or (file, other) in (select file, new_line from a)""")
def touching_added(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("scan_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".sh")).alias("file"))
    e = v.table(spark, sf, "events")
    spot = F.struct("file", (F.floor("value").cast("int") + 25).alias("line"), F.lit("").alias("excerpt"), F.lit("propagation").alias("role"))
    c = e.join(d, e.user_id == d.doc_id).select("event_id", "scan_id", "file", (F.floor("value").cast("int") + 20).alias("line"), F.col("event_id").cast("string").alias("rule"), F.lit("x").alias("excerpt"),
                                                F.array(pt.evidence("context", F.lit("flow"), spot)).alias("evidence"))
    return df.touching_added(c, df.added_lines(df.parse_diffs(_patches(spark, sf)))).select("event_id")


@query("diff_receipts", f"""
with {PATCH_SQL}, b as (select file, string_agg(side || l, chr(10) order by i) as body, sum(case when side <> '+' then 1 else 0 end) as o, sum(case when side <> '-' then 1 else 0 end) as n, bool_or(side <> ' ') as changed from sd group by file),
t as (select file, changed, chr(10) || '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -10,' || o || ' +20,' || n || ' @@' || chr(10) || body || chr(10) as body from b)
select file as path, octet_length(encode(body)) as bytes, sha256(body) as sha256, 'shell' as language from t where regexp_matches(body, '(?m)^(?:\\+[^+]|\\+$|\\+\\+[^+]|\\+\\+$|-[^-]|-$|--[^-]|--$)')""")
def diff_receipts(spark, sf):
    return df.diff_receipts(_patches(spark, sf)).select("path", "bytes", "sha256", "language")


@query("capped_patches", "select doc_id, octet_length(encode(text)) > 4096 as truncated, text as patch from documents")
def capped_patches(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("patch"))
    return df.cap_patches(d, 4096).select("doc_id", "truncated", "patch")


@query("diff_scan_rows", """
with r as (select o_orderkey as scan_id, case o_orderpriority when '1-URGENT' then 'commit' when '2-HIGH' then 'branch_diff' when '3-MEDIUM' then 'working_tree' else 'auto' end as m, case when o_orderstatus <> 'P' then 'b' || o_custkey end as base, o_totalprice > 300000 as t from orders),
e as (select *, case when m = 'auto' then case when base is not null then 'branch_diff' else 'working_tree' end else m end as mode from r)
select scan_id, mode, case when mode in ('commit', 'branch_diff') and base is null then 'base required' when mode = 'working_tree' and base is not null then 'working tree takes no base' end as error,
  case mode when 'commit' then 'par' when 'branch_diff' then base else 'head' end as base_revision, case mode when 'commit' then base else 'head' end as head_revision, not t as complete, case when t then 'warn' else 'ready' end as status from e""")
def diff_scan_rows(spark, sf):
    r = v.table(spark, sf, "orders").selectExpr(
        "o_orderkey as scan_id", "case o_orderpriority when '1-URGENT' then 'commit' when '2-HIGH' then 'branch_diff' when '3-MEDIUM' then 'working_tree' else 'auto' end as requested_mode",
        "case when o_orderstatus <> 'P' then concat('b', o_custkey) end as base", "'head' as head", "'par' as parent", "o_totalprice > 300000 as truncated")
    return df.diff_scan_rows(r)


# ---- taint -------------------------------------------------------------------------------------------------------
TAINT_SQL = f"""{_placed({'R': 1, 'A': 1, 'N': 1})},
t as (select l_orderkey as k, l_linenumber as v from placed where fs = 'RO'
      union select p.l_orderkey, p.l_linenumber from t join placed p on p.l_orderkey = t.k and ((p.fs = 'AO' and p.l_linenumber - 1 = t.v) or (p.fs = 'AF' and p.l_linenumber + 1 = t.v)))"""


def _flow_files(spark, sf):
    n = F.col("l_linenumber")
    var = lambda x: F.concat(F.lit("v"), x.cast("string"))
    stmt = _when(("RO", F.concat(var(n), F.lit(' = request.args.get("a")'))), ("RF", F.concat(var(n), F.lit(' = "request.args"'))), ("AO", F.concat(var(n), F.lit(" = "), var(n - 1), F.lit(' + "x"'))),
                 ("AF", F.concat(var(n), F.lit(" = "), var(n + 1), F.lit(' + "x"'))), ("NO", F.concat(F.lit("os.system("), var(n), F.lit(")"))), ("NF", F.concat(F.lit("requests.get("), var(n), F.lit(", verify=True)"))))
    return v.code_files(spark, sf, ".py", "", stmt)


@query("taint_closure", f"with recursive {TAINT_SQL} select 'src/f' || k || '.py' as file, 'v' || v as name from t")
def taint_closure(spark, sf):
    lang = tt.LANGUAGES["python"]
    lines = pt.explode_lines(_flow_files(spark, sf).select("scan_id", "path", "content"))
    return tt.taint_closure(tt.assignment_facts(lines, lang), ["scan_id", "path"]).select(F.col("path").alias("file"), F.col("node").alias("name"))


@query("assignment_facts", f"""
with {_placed({'R': 1, 'A': 1, 'N': 1})} select file || '.py' as file, start as line, 'v' || l_linenumber as name, fs = 'RO' as from_source,
  case fs when 'RO' then 4 when 'AO' then 2 when 'AF' then 2 else 0 end as n_ids from placed where fs not like 'N%'""")
def assignment_facts(spark, sf):
    lines = pt.explode_lines(_flow_files(spark, sf).select("scan_id", "path", "content"))
    return tt.assignment_facts(lines, tt.LANGUAGES["python"]).select(F.col("path").alias("file"), "line", "name", "from_source", F.size("ids").alias("n_ids"))


@query("local_flow_findings", f"""
with recursive {TAINT_SQL}
select case fs when 'NO' then 'shell-command-construction' else 'ssrf-request-sink' end as rule, file || '.py' as file, start as line from placed join t on t.k = l_orderkey and t.v = l_linenumber where fs like 'N%'""")
def local_flow_findings(spark, sf):
    return _found(tt.emit_flows(tt.program(_flow_files(spark, sf), "python")))


# One function per (order, line number); A functions pass their parameter to the next number.
FN_SQL = """fns as (select l_orderkey as k, l_linenumber as n, min(l_returnflag) as kind, min(l_linestatus) as st from lineitem group by all),
pos as (select *, 1 + 2 * (row_number() over (partition by k order by n) - 1) as start, 2 * count(*) over (partition by k) as body from fns),
s as (select k, n, n as sink from pos where kind = 'R' union select p.k, p.n, s.sink from s join pos p on p.k = s.k and p.kind = 'A' and p.n + 1 = s.n)"""


def _wrapper_files(spark, sf):
    li = v.table(spark, sf, "lineitem")
    f = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("kind"), F.min("l_linestatus").alias("st"))
    n = F.col("l_linenumber").cast("string")
    body = F.when(F.col("kind") == "R", F.lit("    os.system(x)")).when(F.col("kind") == "A", F.concat(F.lit("    f"), (F.col("l_linenumber") + 1).cast("string"), F.lit("(x)"))).otherwise("    y = 'c'")
    f = f.withColumn("def", F.concat(F.lit("def f"), n, F.lit("(x):\n"), body)).withColumn("call", F.when(F.col("st") == "O", F.concat(F.lit("f"), n, F.lit('(request.args.get("q"))'))).otherwise(F.lit("pass")))
    # an order has at most seven line numbers
    g = f.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "def", "call"))).alias("a"))
    text = F.concat(F.array_join(F.transform("a", lambda x: x["def"]), "\n"), F.lit("\n"), F.array_join(F.transform("a", lambda x: x["call"]), "\n"))
    return g.select(F.lit("repo").alias("scan_id"), F.concat(F.lit("src/w"), "l_orderkey", F.lit(".py")).alias("path"), text.alias("content"))


@query("param_sink_summaries", f"""
with recursive {FN_SQL} select 'src/w' || s.k || '.py:f' || s.n as fn, 0 as param, p.start + 1 as sink_line from s join pos p on p.k = s.k and p.n = s.sink""")
def param_sink_summaries(spark, sf):
    return tt.param_sink_summaries(tt.program(_wrapper_files(spark, sf), "python")).select("fn", "param", "sink_line")


@query("wrapper_flow_findings", f"""
with recursive {FN_SQL} select distinct 'shell-command-construction' as rule, 'src/w' || s.k || '.py' as file, p.start + 1 as line
from s join pos c on c.k = s.k and c.n = s.n and c.st = 'O' join pos p on p.k = s.k and p.n = s.sink""")
def wrapper_flow_findings(spark, sf):
    return _found(tt.emit_flows(tt.program(_wrapper_files(spark, sf), "python")))


@query("function_tables", f"with {FN_SQL.split(',' + chr(10) + 's as')[0]} select 'src/w' || k || '.py' as file, 'f' || n as name, start as start_line, start + 2 as end_line from pos")
def function_tables(spark, sf):
    files = _wrapper_files(spark, sf)
    return tt.function_table(files, tt.LANGUAGES["python"]).select(F.col("path").alias("file"), "name", "start_line", "end_line")


@query("call_edges", f"""
with {FN_SQL.split(',' + chr(10) + 's as')[0]}
select 'src/w' || p.k || '.py' as file, p.start + 1 as line, 'src/w' || p.k || '.py:f' || (p.n + 1) as callee from pos p join pos q on q.k = p.k and q.n = p.n + 1 where p.kind = 'A'
union all select 'src/w' || k || '.py', body + (start + 1) // 2, 'src/w' || k || '.py:f' || n from pos where st = 'O'
union all select 'src/w' || k || '.py', start, 'src/w' || k || '.py:f' || n from pos""")
def call_edges(spark, sf):
    return tt.program(_wrapper_files(spark, sf), "python").edges.select(F.col("path").alias("file"), "line", "callee")


@query("import_resolution", """
with f as (select distinct 'b' || replace(p_brand, '#', '') || '/s' || p_size || '.py' as path, 'b' || replace(p_brand, '#', '') as dir, p_size from part),
u as (select p_size from f group by p_size having count(*) = 1)
select path as file, 's' || p_size as local, path as target from f
union all select f.path, 'm' || f.p_size, (select path from f g where g.p_size = f.p_size) from f join u using (p_size)""")
def import_resolution(spark, sf):
    """Each module imports a neighbour by relative path and by bare name; bare names resolve only when unique."""
    p = v.table(spark, sf, "part").select(F.concat(F.lit("b"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("dir"), "p_size").distinct()
    files = p.select(F.lit("s").alias("scan_id"), F.concat("dir", F.lit("/s"), "p_size", F.lit(".py")).alias("path"),
                     F.concat(F.lit("from .s"), "p_size", F.lit(" import s"), "p_size", F.lit("\nimport s"), "p_size", F.lit(" as m"), "p_size").alias("content"))
    lines = pt.explode_lines(files)
    return tt.python_imports(lines, files.select("scan_id", "path")).select(F.col("path").alias("file"), "local", "target")


@query("weak_randomness", f"""
with {_placed({'R': 1, 'A': 1, 'N': 1})}, r as (select l_orderkey as k, l_linenumber as v from placed where fs = 'RO')
select distinct 'weak-randomness-security' as rule, file || '.ts' as file, start as line from placed where fs = 'NO' or (fs like 'A%' and (l_orderkey, l_linenumber) in (select k, v from r))""")
def weak_randomness(spark, sf):
    n = F.col("l_linenumber").cast("string")
    stmt = _when(("RO", F.concat(F.lit("const raw"), n, F.lit(" = Math.random()"))), ("RF", F.concat(F.lit("const raw"), n, F.lit("x = 7"))), ("A", F.concat(F.lit("session.nonce = raw"), n, F.lit(".toString(36)"))),
                 ("NO", F.lit("const r = { verificationCode: 'v-' + Math.random() }")), ("NF", F.lit("const layout = { shade: Math.random() }")))
    return _found(tt.weak_randomness(v.code_files(spark, sf, ".ts", "", stmt)))


@query("constructed_then_used", f"""
with {_placed({'R': 4, 'A': 4, 'N': 4}, 1)} select 'unsafe-deserialization' as rule, file || '.java' as file, start + 2 as line from placed where fs = 'RO'""")
def constructed_then_used(spark, sf):
    def block(stream, use):
        return F.concat(F.lit(" Object "), _name("f"), F.lit("(Request request) throws Exception {\n  ObjectInputStream rd = new ObjectInputStream(" + stream + ");\n  return " + use + ".readObject();\n }"))
    hot = "request.getInputStream()"
    stmt = _when(("RO", block(hot, "rd")), ("RF", block("FIXTURE", "rd")), ("A", block(hot, "other")), ("N", block("FIXTURE", "other")))
    files = v.code_files(spark, sf, ".java", "class X {", stmt, "}")
    return _found(tt.emit_flows(tt.program(files, "java")))


@query("nearest_modules", """
with d as (select distinct 'r' || n_regionkey || '/n' || c_nationkey || '/' || lower(c_mktsegment) as dir, n_regionkey as r, c_nationkey as n from customer join nation on n_nationkey = c_nationkey)
select dir, case when n % 2 = 0 then 'nat' || n else 'reg' || r end as module from d""")
def nearest_modules(spark, sf):
    """Every region has a module file, every other nation its own: the nearest one above a directory wins."""
    c, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation holds 25 rows by definition
    files = j.select(F.lit("s").alias("scan_id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "c_nationkey", F.lit("/"), F.lower("c_mktsegment"), F.lit("/f"), "c_custkey", F.lit(".go")).alias("path"), F.lit("package x").alias("content"))
    reg = n.select(F.lit("s").alias("scan_id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/go.mod")).alias("path"), F.concat(F.lit("module reg"), "n_regionkey").alias("content")).distinct()
    nat = n.filter("n_nationkey % 2 = 0").select(F.lit("s").alias("scan_id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/go.mod")).alias("path"), F.concat(F.lit("module nat"), "n_nationkey").alias("content"))
    return tt.nearest_module(files, reg.unionByName(nat)).select("dir", "module")


@query("sink_calls", f"""
with {_placed({'R': 1, 'A': 1, 'N': 1})}
select case fs when 'NO' then 'shell-command-construction' else 'ssrf-request-sink' end as rule, file || '.py' as file, start as line,
  case fs when 'NO' then 'os.system(v' || l_linenumber || ')' else 'v' || l_linenumber end as expr from placed where fs like 'N%'""")
def sink_calls(spark, sf):
    return tt.program(_flow_files(spark, sf), "python").sinks.select("rule", F.col("path").alias("file"), "line", "expr")


@query("script_credentials", f"""
with {_placed({'R': 1, 'A': 1, 'N': 1})} select 'hardcoded-secret-marker' as rule, file || '.ts' as file, start as line from placed where fs in ('RO', 'AO') group by all""")
def script_credentials(spark, sf):
    key = F.concat_ws("-", "l_suppkey", "l_partkey", "l_orderkey")
    stmt = _when(("RO", F.concat(F.lit("const apiKey = 'live-key-"), key, F.lit("'"))), ("RF", F.lit("const apiKey = 'example-token-value'")),
                 ("AO", F.concat(F.lit("const c = { privateKey: 'private-key-"), key, F.lit("' }"))), ("AF", F.concat(F.lit("settings.accessToken = 'access-token-"), key, F.lit("' + suffix"))), ("N", F.lit("const color = 'blue-and-green'")))
    return _found(pt.embedded_credentials(v.code_files(spark, sf, ".ts", "", stmt), script=True))


@query("script_import_resolution", """
with f as (select distinct 'b' || replace(p_brand, '#', '') as dir, p_size from part)
select dir || '/main.ts' as file, 'f' || p_size as local, dir || '/s' || p_size || case when p_size < 25 then '.ts' else '/index.js' end as target from f""")
def script_import_resolution(spark, sf):
    """Each brand folder imports its own modules by relative path, with or without an index file."""
    p = v.table(spark, sf, "part").select(F.concat(F.lit("b"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("dir"), "p_size").distinct()
    own = p.select(F.lit("s").alias("scan_id"), F.concat("dir", F.lit("/s"), F.col("p_size").cast("string"), F.when(F.col("p_size") < 25, ".ts").otherwise("/index.js")).alias("path"))
    lines = p.select(F.lit("s").alias("scan_id"), F.concat("dir", F.lit("/main.ts")).alias("path"), F.col("p_size").alias("line"),
                     F.concat(F.lit("import { f"), "p_size", F.lit(" } from './x/../s"), "p_size", F.lit("'")).alias("text"))
    return tt.script_imports(lines, own).select(F.col("path").alias("file"), "local", "target")


@query("go_import_resolution", """
with d as (select distinct n_regionkey as r, c_nationkey as n, lower(c_mktsegment) as seg from customer join nation on n_nationkey = c_nationkey)
select 'r' || d.r || '/n' || d.n || '/' || d.seg || '/f.go' as file, 'building' as local, 'r' || d.r || '/n' || b.n || '/building' as to_dir
from d join (select * from d where seg = 'building') b on b.n = d.n""")
def go_import_resolution(spark, sf):
    """Every package imports the building package of its nation through the region's module name."""
    n = v.table(spark, sf, "nation")
    d = v.table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"), F.col("c_nationkey").alias("n"), F.lower("c_mktsegment").alias("seg")).distinct()
    files = d.select(F.lit("s").alias("scan_id"), F.concat(F.lit("r"), "r", F.lit("/n"), "n", F.lit("/"), "seg", F.lit("/f.go")).alias("path"),
                     F.concat(F.lit("package "), "seg", F.lit('\nimport (\n  "fmt"\n  "reg'), "r", F.lit("/n"), "n", F.lit('/building"\n)')).alias("content"))
    mods = n.select(F.lit("s").alias("scan_id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/go.mod")).alias("path"), F.concat(F.lit("module reg"), "n_regionkey").alias("content")).distinct()
    found = tt.go_imports(pt.explode_lines(files), tt.go_packages(files), tt.nearest_module(files, mods))
    return found.select(F.col("path").alias("file"), "local", "to_dir")


@query("repository_scan", f"""
with recursive {TAINT_SQL}
select case fs when 'NO' then 'shell.command.construction' else 'ssrf.request.sink' end as rule_id, file || '.py' as file, start as line, 'low' as confidence
from placed join t on t.k = l_orderkey and t.v = l_linenumber where fs like 'N%'""")
def repository_scan(spark, sf):
    """The whole scan plan over the generated corpus: all text, setting, route, credential and flow jobs."""
    from ..plans.scan import scan_corpus
    return scan_corpus(_flow_files(spark, sf).select("scan_id", "path", "content"), "own/repo").findings.select("rule_id", "file", "line", "confidence")
