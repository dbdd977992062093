"""Scan comparison, digests, drift, bundle checks and remediation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify as cl, compare as cp
from ..plans import views as v
from ..sources import corpus
from .registry import query

SCAN = "concat(l_partkey, ':', l_linenumber)"
ST = "case when l_returnflag = 'R' then 'resolved' when l_returnflag = 'A' then 'false_positive' else 'open' end"
SIDES_SQL = f"""scan as (select l_partkey || ':' || l_linenumber as fingerprint, 'f' || l_orderkey as id, {ST} as status, l_orderkey * 10000 + l_suppkey as ord, l_discount from lineitem),
b as (select fingerprint, arg_max(id, ord) as id, arg_max(status, ord) as status from scan where l_discount < 0.06 group by all),
a as (select fingerprint, arg_max(id, ord) as id, arg_max(status, ord) as status from scan where l_discount >= 0.04 group by all)"""


def _sides(spark, sf):
    # ties in ord carry equal id; the status is made equal too by taking it from the same ordering
    s = v.table(spark, sf, "lineitem").selectExpr(f"{SCAN} as fingerprint", "concat('f', l_orderkey) as id", f"{ST} as status", "l_orderkey * 10000 + l_suppkey as ord", "l_discount")
    return s.filter("l_discount < 0.06"), s.filter("l_discount >= 0.04")


def _compare_sql(gone):
    return f"""with {SIDES_SQL}
select coalesce(a.fingerprint, b.fingerprint) as fingerprint, coalesce(a.id, b.id) as id,
  case when b.fingerprint is null then 'new' when a.fingerprint is null then '{gone}'
       when b.status in ('resolved', 'false_positive') and a.status = 'open' then 'reopened' else 'persisting' end as change
from b full join a on a.fingerprint = b.fingerprint"""


@query("compare_scans", _compare_sql("resolved"))
def compare_scans(spark, sf):
    return cp.compare_scans(*_sides(spark, sf))


@query("compare_partial_scans", _compare_sql("unknown"))
def compare_partial_scans(spark, sf):
    return cp.compare_scans(*_sides(spark, sf), complete=False)


@query("record_seals", """
select o_orderkey, sha256('{"created_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","findings":' || o_custkey || ',"id":"scan_' || o_orderkey || '","mode":' || case when o_orderstatus = 'P' then 'null' else '"' || o_orderstatus || '"' end || '}') as seal from orders""")
def record_seals(spark, sf):
    return _scans(spark, sf).withColumn("seal", F.lit("")).transform(lambda d: d.select("o_orderkey", cp.seal(d.drop("o_orderkey")).alias("seal")))


def _scans(spark, sf):
    return v.table(spark, sf, "orders").selectExpr("o_orderkey", "concat('scan_', o_orderkey) as id", "date_format(o_orderdate, 'yyyy-MM-dd') as created_at",
                                                   "o_custkey as findings", "case when o_orderstatus <> 'P' then o_orderstatus end as mode")


@query("scan_history", "select 'scan_' || o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as created_at from orders where o_orderpriority <> '1-URGENT'")
def scan_history(spark, sf):
    s = _scans(spark, sf).drop("o_orderkey")
    sealed = s.withColumn("seal", cp.seal(s)).join(v.table(spark, sf, "orders").selectExpr("concat('scan_', o_orderkey) as id", "o_orderpriority"), "id")
    # urgent rows are altered after sealing
    altered = sealed.withColumn("findings", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("findings") + 1).otherwise(F.col("findings"))).drop("o_orderpriority")
    return cp.scan_history(altered).select("id", "created_at")


@query("snapshot_digests", f"""
with files as ({v.FILES_SQL}),
p as (select scan_id as scan_id, left(sha256(path), 3) as bucket, count(*) as n, sha256(string_agg(path || chr(0) || sha256(content), chr(10) order by path)) as d from files group by all)
select scan_id, cast(sum(n) as bigint) as n_files, 'scanlake-snapshot/v2:sha256:' || sha256(string_agg(bucket || ':' || d, chr(10) order by bucket)) as digest from p group by scan_id""")
def snapshot_digests(spark, sf):
    return cp.snapshot_digest(corpus.file_receipts(v.files(spark, sf)))


@query("snapshot_tree_digest", f"""
with files as ({v.FILES_SQL}),
p as (select 'all' as scan_id, left(sha256(path), 3) as bucket, count(*) as n, sha256(string_agg(path || chr(0) || sha256(content), chr(10) order by path)) as d from files group by all)
select scan_id, cast(sum(n) as bigint) as n_files, 'scanlake-snapshot/v2:sha256:' || sha256(string_agg(bucket || ':' || d, chr(10) order by bucket)) as digest from p group by scan_id""")
def snapshot_tree_digest(spark, sf):
    """The whole corpus as one scan, so that buckets hold several files."""
    return cp.snapshot_digest(corpus.file_receipts(v.files(spark, sf)).withColumn("scan_id", F.lit("all")))


VERSIONS_SQL = f"""files as ({v.FILES_SQL}), j as (select f.*, l.quality, l.toxic from files f left join labels l using (doc_id)),
later as (select scan_id, path, case when quality = 0 then upper(content) else content end as content from j where toxic is null or toxic = 0)"""


def later_files(spark, sf):
    """A later version of the corpus: toxic documents are gone, low-quality ones are altered."""
    j = v.files(spark, sf).join(v.table(spark, sf, "labels"), "doc_id", "left")
    return j.filter("toxic is null or toxic = 0").withColumn("content", F.when(F.col("quality") == 0, F.upper("content")).otherwise(F.col("content")))


@query("snapshot_drift", f"""
with {VERSIONS_SQL},
f2 as (select 'a' as scan_id, doc_id || '.txt' as path, content from files union all select 'b', doc_id || '.txt', content || 'b' from files),
l2 as (select 'a' as scan_id, split_part(split_part(path, '/', 2), '.', 1) || '.txt' as path, content from later union all select 'b', doc_id || '.txt', content || 'b' from files)
select f.scan_id, f.path, case when l.path is null then 'missing' else 'changed' end as state from f2 f left join l2 l on l.path = f.path and l.scan_id = f.scan_id
where l.path is null or l.content <> f.content""")
def snapshot_drift(spark, sf):
    """Two scans that share all paths: only the first one changed."""
    def scan(name, df, tail):
        return df.select(F.lit(name).alias("scan_id"), F.concat("doc_id", F.lit(".txt")).alias("path"), F.concat("content", F.lit(tail)).alias("content"), "doc_id")

    files = v.files(spark, sf)
    before = scan("a", files, "").unionByName(scan("b", files, "b"))
    after = scan("a", later_files(spark, sf), "").unionByName(scan("b", files, "b"))
    return cp.drift(corpus.file_receipts(before), after)


ART_PATH = "case when event_type = 'error' then 'findings/' when event_type = 'click' then 'hardening/' else 'artifacts/' end"


@query("artifact_manifest", """
select 'u' || user_id as scan_id, 'artifacts/' || event_id || case when value >= 10 then '.json' else '.md' end as path, sha256(props) as sha256,
  case when value >= 10 then 'application/json' else 'text/markdown' end as media_type from events where event_type not in ('error', 'click')""")
def artifact_manifest(spark, sf):
    return cp.artifact_manifest(_artifacts(spark, sf))


def _artifacts(spark, sf):
    return v.table(spark, sf, "events").selectExpr("concat('u', user_id) as scan_id", f"concat({ART_PATH}, event_id, case when value >= 10 then '.json' else '.md' end) as path", "props as content", "value", "event_type")


@query("bundle_errors", """
with act as (select 'u' || user_id as scan_id, 'artifacts/' || event_id || case when value >= 10 then '.json' else '.md' end as path, sha256(props) as sha, value, event_type from events where event_type not in ('error', 'click')),
man as (select scan_id, path, case when event_type = 'view' and value < 5 then sha256('other') when value >= 50 then 'short' else sha end as sha from act where event_type <> 'purchase' or value < 30
        union all select scan_id, path, sha from act where event_type = 'signup' and value < 3
        union all select 'u' || user_id, 'artifacts/lost' || event_id, sha256(props) from events where event_type = 'error' and value < 4),
good as (select * from man where length(sha) = 64)
select scan_id, path, 'invalid descriptor' as error from man where length(sha) <> 64
union all select scan_id, path, 'repeated' from good group by all having count(*) > 1
union all select coalesce(g.scan_id, a.scan_id), coalesce(g.path, a.path), case when a.path is null then 'missing' when g.path is null then 'not sealed' else 'digest mismatch' end
from (select distinct scan_id, path, sha from good) g full join act a on a.scan_id = g.scan_id and a.path = g.path where a.path is null or g.path is null or a.sha <> g.sha""")
def bundle_errors(spark, sf):
    arts = _artifacts(spark, sf)
    actual = cp.artifact_manifest(arts)
    kept = arts.filter("event_type not in ('error', 'click')").withColumn("sha256", tx.sha256(F.col("content")))
    main = kept.filter("event_type <> 'purchase' or value < 30").select("scan_id", "path", F.when((F.col("event_type") == "view") & (F.col("value") < 5), tx.sha256(F.lit("other")))
                                                                        .when(F.col("value") >= 50, "short").otherwise(F.col("sha256")).alias("sha256"))
    again = kept.filter("event_type = 'signup' and value < 3").select("scan_id", "path", "sha256")
    lost = v.table(spark, sf, "events").filter("event_type = 'error' and value < 4").select(
        F.concat(F.lit("u"), "user_id").alias("scan_id"), F.concat(F.lit("artifacts/lost"), "event_id").alias("path"), tx.sha256(F.col("props")).alias("sha256"))
    return cp.manifest_errors(main.unionByName(again).unionByName(lost), actual)


@query("oversize_documents", "select source as scan_id, 'coverage.json' as path, 'too large' as error, count(*) as n from documents where length(text) > 8192 group by all")
def oversize_documents(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("source").alias("scan_id"), F.lit("coverage.json").alias("path"), F.col("text").alias("content"))
    return cp.size_errors(d, {"coverage.json": 8192}).groupBy("scan_id", "path", "error").agg(F.count("*").alias("n"))


@query("receipt_gaps", """
with c as (select 'u' || user_id as scan_id, user_id % 5 || ':' || cast(cast(ts as date) as varchar) as candidate_id, event_type, value from events),
g as (select scan_id, candidate_id, bool_or(event_type = 'signup') as d, bool_or(event_type = 'view') as v, bool_or(event_type = 'click') as a, max(value) >= 20 as rep from c group by all)
select scan_id, candidate_id, 'no discovery receipt' as error from g where not d union all select scan_id, candidate_id, 'no validation receipt' from g where not v
union all select scan_id, candidate_id, 'no attack-path receipt' from g where rep and not a""")
def receipt_gaps(spark, sf):
    from .ledger import cands, log
    return cp.receipt_gaps(cands(spark, sf), log(spark, sf))


@query("stale_digests", f"""
with {VERSIONS_SQL} select f.path as id, case when l.path is null then 'no report' else 'stale' end as error from files f left join later l on l.path = f.path where l.path is null or l.content <> f.content""")
def stale_digests(spark, sf):
    digest = lambda d: d.select(F.col("path").alias("id"), tx.sha256(F.col("content")).alias("digest"))
    return cp.stale_digests(digest(later_files(spark, sf)), digest(v.files(spark, sf)))


@query("remediation_verdicts", """
with f as (select l_orderkey, l_linenumber, l_suppkey, l_linestatus as scan_id, l_returnflag as rule_id, l_partkey as file from lineitem where l_discount < 0.05),
r as (select distinct l_linestatus as scan_id, l_returnflag as rule_id, l_partkey as file from lineitem where l_discount >= 0.05)
select l_orderkey, l_linenumber, l_suppkey, case when r.file is not null then 'still_detected' else 'not_detected' end as verdict from f left join r using (scan_id, rule_id, file)""")
def remediation_verdicts(spark, sf):
    li = v.table(spark, sf, "lineitem")
    f = li.filter("l_discount < 0.05").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus as scan_id", "l_returnflag as rule_id", "l_partkey as file")
    r = li.filter("l_discount >= 0.05").select(F.col("l_linestatus").alias("scan_id"), F.col("l_returnflag").alias("rule_id"), F.array(F.struct(F.col("l_partkey").alias("file"))).alias("locations"))
    return cp.remediation_verdict(f, r).select("l_orderkey", "l_linenumber", "l_suppkey", "verdict")


@query("safe_rewrites", f"""
with files as (select 'd' || doc_id as scan_id, 'f' || doc_id % 10 as path, case when lang = 'en' then 'verify = False  x' when lang = 'fr' then 'rejectUnauthorized :  false' else '"verify_signature": False' end || chr(10) || text as content, lang from documents)
select scan_id, path, sha256(case when lang = 'en' then replace(content, 'verify = False  x', 'verify = True  x') when lang = 'fr' then replace(content, 'rejectUnauthorized :  false', 'rejectUnauthorized: true')
  else replace(content, '"verify_signature": False', '"verify_signature": True') end) as new_sha from files""")
def safe_rewrites(spark, sf):
    d = v.table(spark, sf, "documents")
    head = F.when(F.col("lang") == "en", "verify = False  x").when(F.col("lang") == "fr", "rejectUnauthorized :  false").otherwise('"verify_signature": False')
    files = d.select(F.concat(F.lit("d"), "doc_id").alias("scan_id"), F.concat(F.lit("f"), F.col("doc_id") % 10).alias("path"), F.concat_ws("\n", head, "text").alias("content"), "lang")
    found = files.select("scan_id", F.col("path").alias("file"), F.when(F.col("lang").isin("en", "fr"), "tls.verification.disabled").otherwise("jwt.verification.disabled").alias("rule_id"))
    return cp.safe_rewrites(files, found).select("scan_id", "path", tx.sha256(F.col("new_content")).alias("new_sha"))


@query("applied_replacements", f"""
with files as ({v.FILES_SQL}), l as (select *, string_split_regex(content, '\\r?\\n') as ls from files)
select path, case when len(ls) < 2 then 'range outside file' when trim(ls[2]) = '' and ls[2] = '' then 'invalid text' when lang_bad then 'expected text differs' end as error,
  case when len(ls) >= 2 and ls[2] <> '' and not lang_bad then sha256(array_to_string([ls[1], 'new line'] || ls[3:], chr(10))) end as new_sha
from (select *, path like '%.fr' as lang_bad from l)""")
def applied_replacements(spark, sf):
    files = v.files(spark, sf)
    lines = tx.split_lines(F.col("content"))
    second = F.coalesce(F.get(lines, F.lit(1)), F.lit("none"))
    req = files.select("scan_id", F.col("path").alias("request_id"), "path", F.lit(2).alias("start_line"), F.lit(2).alias("end_line"),
                       F.when(F.endswith("path", F.lit(".fr")) & (second != ""), F.concat(second, F.lit("!"))).otherwise(second).alias("expected_text"),
                       F.lit("new line").alias("replacement_text"), tx.sha256(F.col("content")).alias("base_sha256"))
    out = cp.apply_replacements(files, req)
    return out.select("path", "error", tx.sha256(F.col("new_content")).alias("new_sha"))


@query("source_ranges", f"""
with files as ({v.FILES_SQL}), l as (select path, string_split_regex(content, '\\r?\\n') as ls from files)
select path, 2 as from_line, least(4, len(ls)) as to_line, sha256(coalesce(array_to_string(ls[2:4], chr(10)), '')) as text_sha from l""")
def source_ranges(spark, sf):
    files = v.files(spark, sf)
    req = files.select("scan_id", "path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return cl.read_range(files, req).select("path", "from_line", "to_line", tx.sha256(F.col("text")).alias("text_sha"))
