"""Finding intake from landed documents: SARIF logs, generic JSON or text, alert pages, tickets.

Documents are rows ``(source_path, content)``; JSON of unknown shape is read as Spark variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..scale import running_sum

SOURCE_TYPES = ("sarif", "cve", "advisory", "scanner_ticket", "bug_bounty", "freeform", "generic", "text")
LOCATIONS = "array<struct<file:string,line:int>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; also serves landed API pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def words(v: Column, path: str) -> Column:
    """Trimmed text of a string member; null for anything else or blank."""
    text = tx.trim(F.try_variant_get(v, path, "string"))
    return F.when((_kind(v, path) == "STRING") & (text != ""), text)


def value(v: Column, path: str) -> Column:
    """Text of a string or number member; null otherwise."""
    text = tx.trim(F.try_variant_get(v, path, "string"))
    return F.when(_kind(v, path).rlike(r"^(?:STRING\z|BIGINT|DOUBLE|DECIMAL)"), F.when(text != "", text))


def members(v: Column, path: str) -> Column:
    """Array member as variants; empty when it is not an array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _number(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(_kind(v, p).rlike(r"^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, p, "int")) for p in paths])


def locations_of(items: Column) -> Column:
    """File and line of each location, in plain or SARIF shape; entries without a file are dropped."""
    spot = lambda x: F.struct(
        F.coalesce(words(x, "$.file"), words(x, "$.path"), words(x, "$.physicalLocation.artifactLocation.uri")).alias("file"),
        _number(x, "$.line", "$.startLine", "$.physicalLocation.region.startLine").alias("line"))
    return F.filter(F.transform(items, spot), lambda s: s.file.isNotNull()).cast(LOCATIONS)


def parsed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("v", F.try_parse_json("content")).withColumn("source_sha256", tx.sha256(F.col("content")))


def sarif_results(docs: DataFrame) -> DataFrame:
    """Runs x results of SARIF 2.1.0 documents, with the rule of the same run looked up by id."""
    d = parsed(docs).filter((words(F.col("v"), "$.version") == "2.1.0") & _kind(F.col("v"), "$.runs").rlike("^ARRAY"))
    runs = d.select("source_path", "source_sha256", F.posexplode(members(F.col("v"), "$.runs")).alias("run", "r"))
    rules = runs.select("source_path", "run", F.posexplode(members(F.col("r"), "$.tool.driver.rules")).alias("pos", "u"))
    u = F.col("u")
    rules = rules.select("source_path", "run", "pos", words(u, "$.id").alias("rule_id"), F.struct(
        words(u, "$.shortDescription.text").alias("short"), words(u, "$.fullDescription.text").alias("full"),
        F.filter(F.transform(members(u, "$.properties.tags"), lambda t: words(t, "$")), lambda t: t.isNotNull()).alias("tags")).alias("rule"))
    rules = rules.filter("rule_id is not null").groupBy("source_path", "run", "rule_id").agg(F.max_by("rule", "pos").alias("rule"))
    res = runs.select("source_path", "source_sha256", "run", F.posexplode(members(F.col("r"), "$.results")).alias("pos", "x"))
    x = F.col("x")
    res = res.select(
        "source_path", "source_sha256", "run", "pos", words(x, "$.ruleId").alias("rule_id"),
        F.coalesce(words(x, "$.message.text"), words(x, "$.message.markdown")).alias("message"), words(x, "$.level").alias("severity"),
        F.filter(F.transform(members(x, "$.properties.tags"), lambda t: words(t, "$")), lambda t: t.isNotNull()).alias("own_tags"),
        words(x, "$.properties.cwe").alias("own_cwe"), locations_of(members(x, "$.locations")).alias("locations"))
    j = res.join(rules, ["source_path", "run", "rule_id"], "left")
    tags = F.concat("own_tags", F.coalesce("rule.tags", F.array().cast("array<string>")))
    cwe = F.coalesce(F.get(F.filter(tags, lambda t: t.rlike(r"(?i)^CWE-[0-9]+\z")), F.lit(0)), "own_cwe")
    return j.select("source_path", "source_sha256", "run", "pos", "rule_id",
                    F.coalesce("rule.short", "rule.full", "rule_id", "message").alias("title"),
                    F.coalesce("message", "rule.full").alias("description"), "severity", cwe.alias("cwe"), "locations",
                    F.lit("sarif").alias("source_type"))


# ---- fixed values: accepted member names per field, first present wins -----------------------------
ALIASES = {
    "component": ("component", "package"),
    "affected_version": ("affectedVersion", "affected_version", "vulnerableVersionRange", "vulnerable_version_range"),
    "package_ecosystem": ("packageEcosystem", "package_ecosystem", "ecosystem"),
    "manifest_path": ("manifestPath", "manifest_path"),
    "claimed_source": ("claimedSource", "source"),
    "claimed_control": ("claimedControl", "control"),
    "claimed_sink": ("claimedSink", "sink"),
    "preconditions": ("preconditions",),
    "impact": ("impact",),
}


def read_findings(docs: DataFrame) -> DataFrame:
    """Findings of generic JSON (list, ``findings`` list or one object) or text documents.

    A JSON object without a description falls back to its JSON text (members in name order).
    """
    d = parsed(docs)
    v = F.col("v")
    is_sarif = F.coalesce((words(v, "$.version") == "2.1.0") & _kind(v, "$.runs").rlike("^ARRAY"), F.lit(False))
    kind = _kind(v, "$")
    listed = members(v, "$.findings")
    items = F.when(kind.rlike("^ARRAY"), members(v, "$")).when(kind.rlike("^OBJECT"), F.when(F.size(listed) > 0, listed).otherwise(F.array(v))) \
        .otherwise(F.array(F.lit(None).cast("variant")))
    e = d.filter(~is_sarif).select("source_path", "source_sha256", "content", F.posexplode(items).alias("pos", "x"))
    x = F.col("x")
    is_text = F.col("x").isNull()
    title = F.coalesce(F.when(is_text, tx.basename(F.col("source_path"))), words(x, "$.title"), words(x, "$.name"),
                       F.concat(F.lit("Imported finding "), (F.col("pos") + 1).cast("string")))
    e = e.withColumn("title", title)
    pick = lambda names: F.coalesce(*[value(x, f"$.{n}") for n in names])
    kind_of = words(x, "$.sourceType")
    return e.select(
        F.concat(F.lit("imp_"), F.substring(tx.sha256(tx.joined("source_sha256", "pos", "title")), 1, 24)).alias("id"),
        F.coalesce(value(x, "$.id"), value(x, "$.inputId")).alias("input_id"), "title",
        F.coalesce(F.when(is_text, tx.trim(F.col("content"))), words(x, "$.description"), words(x, "$.summary"), F.to_json(x)).alias("description"),
        words(x, "$.severity").alias("severity"), words(x, "$.cwe").alias("cwe"), words(x, "$.ruleId").alias("rule_id"),
        F.when(is_text, "text").when(kind_of.isin(list(SOURCE_TYPES)), kind_of).otherwise("generic").alias("source_type"),
        F.when(is_text, F.array().cast(LOCATIONS)).otherwise(locations_of(members(x, "$.locations"))).alias("locations"),
        "source_path", "source_sha256", "pos", *[pick(names).alias(c) for c, names in ALIASES.items()])


def sarif_findings(docs: DataFrame) -> DataFrame:
    """SARIF results with imported ids: index counts results over all runs of one document.

    The index is the number of results in earlier runs plus the position in the own run.
    """
    r = sarif_results(docs)
    per_run = running_sum(r.groupBy("source_path", "run").agg(F.count("*").alias("n")), ["source_path"], ["run"], F.col("n"), "upto")
    before = per_run.select("source_path", "run", (F.col("upto") - F.col("n")).alias("base"))
    r = r.join(before, ["source_path", "run"], "left").withColumn("index", F.col("pos") + F.coalesce("base", F.lit(0)))
    return r.withColumn("id", F.concat(F.lit("imp_"), F.substring(tx.sha256(tx.joined("source_sha256", "index", F.coalesce("title", F.lit("")))), 1, 24))) \
        .drop("base", "run", "pos")


# ---- alert pages -----------------------------------------------------------------------------------------

def normalize_alerts(raw: DataFrame, instances: DataFrame, source: str) -> DataFrame:
    """Landed alert objects of one source, with instance locations joined by (repository, number).

    ``raw(repository, pos, alert)`` and ``instances(repository, number, instance)`` hold JSON text.
    """
    a = raw.withColumn("v", F.try_parse_json("alert"))
    v = F.col("v")
    number = F.coalesce(value(v, "$.number"), value(v, "$.ghsa_id"), F.concat(F.lit(f"{source}-"), (F.col("pos") + 1).cast("string")))
    single = F.coalesce(value(v, "$.security_advisory.cve_id"), F.get(F.transform(members(v, "$.security_advisory.cve_ids"), lambda c: words(c, "$")), F.lit(0)))
    a = a.withColumn("number", number).withColumn("cve", F.when(single.rlike("(?i)^CVE-"), single))
    i = instances.withColumn("w", F.try_parse_json("instance"))
    w = F.col("w")

    def spot(x):
        path = F.coalesce(value(x, "$.most_recent_instance.location.path"), value(x, "$.location.path"), value(x, "$.path"))
        return F.struct(path.alias("file"), _number(x, "$.most_recent_instance.location.start_line", "$.location.start_line", "$.line").alias("line"))
    # a filter before the grouping would parse every instance again for each path it looks at; the set leaves nulls out itself
    spots = i.select("repository", "number", spot(w).alias("s")).groupBy("repository", "number") \
        .agg(F.array_sort(F.collect_set(F.when(F.col("s.file").isNotNull(), F.col("s")))).alias("i_locations"))
    empty = F.array().cast(LOCATIONS)
    if source == "code_scanning":
        a = a.join(spots, ["repository", "number"], "left").withColumn("locations", F.coalesce(F.col("i_locations").cast(LOCATIONS), empty))
    else:
        a = a.withColumn("locations", F.filter(F.array(spot(v)), lambda s: s.file.isNotNull()).cast(LOCATIONS))
    title = F.coalesce(value(v, "$.rule.description"), value(v, "$.security_advisory.summary"), value(v, "$.summary"),
                       F.concat(F.lit(f"GitHub {source} finding "), "number"))
    body = F.array_join(tx.compact(
        F.concat(F.lit("GitHub finding: "), value(v, "$.html_url")),
        F.coalesce(value(v, "$.rule.full_description"), value(v, "$.security_advisory.description"), value(v, "$.description")),
        F.concat(F.lit("Dismissal context: "), value(v, "$.dismissed_reason"))), "\n\n")
    input_id = F.concat_ws(":", "repository", F.lit(source), "number")
    a = a.withColumn("title", title)
    return a.select(
        F.concat(F.lit("gh_"), F.substring(tx.sha256(input_id), 1, 24)).alias("id"), input_id.alias("input_id"), "title",
        F.when(body != "", body).otherwise(F.col("title")).alias("description"),
        F.coalesce(value(v, "$.rule.severity"), value(v, "$.security_advisory.severity")).alias("severity"),
        F.coalesce(value(v, "$.rule.cwe_id"), "cve").alias("cwe"), value(v, "$.rule.id").alias("rule_id"),
        F.lit("sarif").alias("source_type") if source == "code_scanning" else F.when(F.col("cve").isNotNull(), "cve").otherwise("advisory").alias("source_type"),
        "locations", F.coalesce(value(v, "$.dependency.package.name"), value(v, "$.security_vulnerability.package.name")).alias("component"),
        F.coalesce(value(v, "$.security_vulnerability.vulnerable_version_range"), value(v, "$.vulnerable_version_range")).alias("affected_version"),
        F.coalesce(value(v, "$.dependency.package.ecosystem"), value(v, "$.security_vulnerability.package.ecosystem")).alias("package_ecosystem"),
        F.coalesce(value(v, "$.manifest_path"), value(v, "$.dependency.manifest_path")).alias("manifest_path"), value(v, "$.state").alias("state"))


def normalize_tickets(raw: DataFrame, provider: str) -> DataFrame:
    """Landed ticket objects of one of two trackers. ``raw(endpoint, ticket)`` holds JSON text."""
    t = raw.withColumn("v", F.try_parse_json("ticket")).withColumn("endpoint", F.regexp_replace("endpoint", r"/\z", ""))
    v = F.col("v")
    if provider == "jira":
        key = F.coalesce(value(v, "$.key"), F.lit("unknown"))
        url = F.concat("endpoint", F.lit("/browse/"), key)
        text = F.coalesce(F.when(_kind(v, "$.fields.description") == "STRING", F.try_variant_get(v, "$.fields.description", "string")),
                          F.to_json(F.try_variant_get(v, "$.fields.description", "variant")), F.lit('""'))
        title = F.coalesce(value(v, "$.fields.summary"), F.concat(F.lit("Jira security ticket "), key))
        severity, state = value(v, "$.fields.priority.name"), value(v, "$.fields.status.name")
        component = F.array_join(F.filter(F.transform(members(v, "$.fields.components"), lambda c: value(c, "$.name")), lambda c: c.isNotNull()), ", ")
        body = F.concat(text, F.lit("\n\nJira ticket: "), url)
    else:
        key = F.coalesce(value(v, "$.identifier"), value(v, "$.id"), F.lit("unknown"))
        url = F.coalesce(value(v, "$.url"), F.col("endpoint"))
        title = F.coalesce(value(v, "$.title"), F.concat(F.lit("Linear security ticket "), key))
        severity, state = F.coalesce(value(v, "$.priorityLabel.name"), value(v, "$.priority")), value(v, "$.state.name")
        component = F.coalesce(value(v, "$.team.name"), F.lit(""))
        body = F.concat(F.coalesce(value(v, "$.description"), F.lit("")), F.lit("\n\nLinear ticket: "), url)
    return t.select(
        F.concat(F.lit(f"{provider}_"), F.substring(tx.sha256(F.concat_ws(":", "endpoint", key)), 1, 24)).alias("id"),
        F.concat(F.lit(f"{provider}:"), key).alias("input_id"), title.alias("title"), tx.trim(body).alias("description"), severity.alias("severity"),
        F.lit("scanner_ticket").alias("source_type"), url.alias("reference"), F.when(component != "", component).alias("component"), state.alias("state"))
