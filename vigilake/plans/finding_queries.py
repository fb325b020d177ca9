"""Queries about findings: order, duplicates, suppression, baselines, aggregates and reports.

The findings come from small repositories, one file for each row of supplier and each sample: reported, clean, behind comment
marks, or reported in a docs folder, by the row's key. Their SQL is known from the key and the samples' marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as X
from vigilake.functions import reports
from vigilake.operators import findings as P
from vigilake.operators import rules, suppressions
from vigilake.plans import samples as S
from vigilake.plans.registry import query
from vigilake.plans.rule_queries import COLUMNS, expected, sample_files
from vigilake.session import cut, spread, table

REPO_SQL = "'repo' || (s_suppkey % 10) || '/' || CASE WHEN s_suppkey % 4 = 3 THEN 'docs/' ELSE '' END || s_suppkey || '_'"
FOUND_SQL = f"WITH findings AS ({expected(S.REPOSITORY, 'supplier', 's_suppkey', 's_suppkey % 4 IN (0, 3)', REPO_SQL)})"
RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
CONF = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
ORDER = f"{RANK}, file, line, message, code, kind, text"
FNV = "lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(code || chr(1) || file || chr(1) || message, ''), lambda c: unicode(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)), 16, '0'))"


def repositories(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    prefix = F.concat(F.lit("repo"), (s % 10).cast("string"), F.lit("/"), F.when(s % 4 == 3, "docs/").otherwise(""), s.cast("string"), F.lit("_"))
    keys = table(spark, sf, "supplier").select(s.cast("string").alias("k"), F.element_at(F.array(*(F.lit(m) for m in (0, 1, 2, 0))), (s % 4 + 1).cast("int")).alias("mode"), prefix.alias("prefix"))
    return sample_files(keys, S.REPOSITORY, F.col("prefix"))


def found(spark, sf) -> DataFrame:
    return rules.run(repositories(spark, sf), S.FOUND).select(*COLUMNS, "col")


def once(spark, sf) -> DataFrame:
    """Findings for queries that read them more than once."""
    return cut(found(spark, sf))


# findings: order, duplicates, anti joins

@query("finding_fingerprint", f"{FOUND_SQL} SELECT DISTINCT code, file, message, {FNV} AS fingerprint FROM findings")
def finding_fingerprint(spark, sf):
    return found(spark, sf).select("code", "file", "message").distinct().withColumn("fingerprint", P.fingerprint())


@query("findings_top_n", f"{FOUND_SQL} SELECT kind, code, severity, file, line, message FROM findings ORDER BY {ORDER} LIMIT 25")
def findings_top_n(spark, sf):
    return P.top_n(found(spark, sf), 25).select("kind", "code", "severity", "file", "line", "message")


# aggregates

@query("severity_counts", f"{FOUND_SQL} SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM findings")
def severity_counts(spark, sf):
    return found(spark, sf).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in X.SEVERITIES), F.count("*").alias("total"))


REPO = "string_split(file, '/')[1]"


@query("repo_summary", f"{FOUND_SQL} SELECT {REPO} AS repo, category, code, coalesce(confidence, 'unknown') AS confidence, count(*) AS n FROM findings GROUP BY ALL")
def repo_summary(spark, sf):
    return found(spark, sf).groupBy(F.split("file", "/")[0].alias("repo"), "category", "code", F.coalesce("confidence", F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


@query("global_summary", f"{FOUND_SQL} SELECT sum(n) AS total, CAST(floor(sum(n) / count(*) + 0.5) AS BIGINT) AS mean_repo, max(n) AS most FROM (SELECT {REPO} AS repo, count(*) AS n FROM findings GROUP BY 1)")
def global_summary(spark, sf):
    per = found(spark, sf).groupBy(F.split("file", "/")[0].alias("repo")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.floor(F.sum("n") / F.count("*") + 0.5).alias("mean_repo"), F.max("n").alias("most"))


@query("confidence_distribution", f"{FOUND_SQL} SELECT confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM findings GROUP BY confidence")
def confidence_distribution(spark, sf):
    per = found(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("t")))).select("confidence", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("pct"))


@query("top_entries", f"{FOUND_SQL} SELECT code, count(*) AS n FROM findings GROUP BY code ORDER BY n DESC, code LIMIT 5")
def top_entries(spark, sf):
    return found(spark, sf).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(5)


@query("cwe_taxonomy", f"{FOUND_SQL} SELECT code, array_to_string(list_sort(list(DISTINCT cwe)), '|') AS cwes FROM findings WHERE cwe <> '' GROUP BY code")
def cwe_taxonomy(spark, sf):
    return found(spark, sf).where("cwe <> ''").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("cwe")), "|").alias("cwes"))


# report rows

@query("sarif_results", f"""{FOUND_SQL} SELECT code, file, line, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
 CASE severity WHEN 'high' THEN 80 WHEN 'medium' THEN 50 ELSE 25 END + CASE confidence WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 0 END AS rank,
 CASE WHEN length(text) > 320 THEN substr(text, 1, 320) || '…' ELSE text END AS snippet FROM findings""")
def sarif_results(spark, sf):
    s, c = F.col("severity"), F.col("confidence")
    return found(spark, sf).select("code", "file", "line", X.sarif_level(s).alias("level"), X.sarif_rank(s, c).alias("rank"), X.clamp(F.col("text")).alias("snippet"))


@query("csv_rows", f"""{FOUND_SQL} SELECT CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || code || ',' || line AS row FROM findings""")
def csv_rows(spark, sf):
    return found(spark, sf).select(F.concat_ws(",", X.csv_field(F.col("text")), "code", F.col("line").cast("string")).alias("row"))


@query("junit_rows", f"""{FOUND_SQL} SELECT '<testcase classname="' || code || '" name="' || file || ':' || line || '"><failure>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</failure></testcase>' AS row FROM findings""")
def junit_rows(spark, sf):
    return found(spark, sf).select(F.format_string('<testcase classname="%s" name="%s:%d"><failure>%s</failure></testcase>', "code", "file", "line", X.xml_text(F.col("text"))).alias("row"))


@query("gitlab_security_ids", f"{FOUND_SQL}, h AS (SELECT code, file, line, sha1(code || '|' || file || '|' || line) AS s FROM findings) SELECT DISTINCT code, file, line, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21, 12) AS id FROM h")
def gitlab_security_ids(spark, sf):
    return found(spark, sf).select("code", "file", "line", X.uuid_of(F.concat_ws("|", "code", "file", F.col("line").cast("string"))).alias("id")).distinct()


@query("markdown_rows", f"{FOUND_SQL} SELECT '| ' || severity || ' | ' || code || ' | ' || file || ':' || line || ' | ' || replace(message, '|', '\\|') || ' |' AS row FROM findings")
def markdown_rows(spark, sf):
    return found(spark, sf).select(F.format_string("| %s | %s | %s:%d | %s |", "severity", "code", "file", "line", F.replace("message", F.lit("|"), F.lit("\\|"))).alias("row"))


# the same finding twice

@query("dedupe_keep_first", f"{FOUND_SQL} SELECT kind, code, file, message, severity, line FROM findings")
def dedupe_keep_first(spark, sf):
    f = once(spark, sf)
    again = f.where("line % 2 = 0").withColumn("severity", F.lit("low")).unionByName(f)
    return P.keep_first(f.unionByName(again), *P.SAME).select("kind", "code", "file", "message", "severity", "line")


@query("dedupe_keep_best", f"{FOUND_SQL} SELECT kind, code, file, severity, confidence, line, message FROM findings")
def dedupe_keep_best(spark, sf):
    """Each finding comes once more with less confidence, and some with less severity; findings of two rules on one line stay two."""
    f = once(spark, sf)
    worse = f.withColumn("confidence", F.lit("low")).unionByName(f.where("line % 2 = 0").withColumn("severity", F.lit("low")))
    return P.keep_best(worse.unionByName(f), *P.SAME_PLACE).select("kind", "code", "file", "severity", "confidence", "line", "message")


LINES_SQL = ", ".join(f"({i}, {n}, '{line.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(S.REPOSITORY) for n, line in enumerate(s.reported.split(chr(10)), 1))


@query("context_hash", f"""{FOUND_SQL}, ls(sample, n, line) AS (VALUES {LINES_SQL})
SELECT f.kind, f.code, f.file, f.line, substr(sha1(string_agg(trim(regexp_replace(replace(ls.line, '{{k}}', f.k::VARCHAR), '\\s+', ' ', 'g'), ' '), chr(10) ORDER BY n)), 1, 16) AS context_hash
FROM (SELECT DISTINCT kind, code, file, line, k, sample FROM findings) f JOIN ls ON ls.sample = f.sample AND ls.n BETWEEN f.line - 2 AND f.line + 2 GROUP BY f.kind, f.code, f.file, f.line""")
def context_hash(spark, sf):
    return P.context_hash(found(spark, sf), repositories(spark, sf))


# what keeps findings back

@query("diff_against", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE severity <> 'high'")
def diff_against(spark, sf):
    f = once(spark, sf)
    key = F.concat_ws(":", "code", "file", F.col("line").cast("string"))
    return f.withColumn("key", key).join(f.where("severity = 'high'").select(key.alias("key")).distinct(), "key", "left_anti").select("kind", "code", "file", "line")


@query("changed_since", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE k % 3 = 1")
def changed_since(spark, sf):
    changed = repositories(spark, sf).where("cast(k as int) % 3 = 1").select(F.col("path").alias("file"))
    return found(spark, sf).join(changed, "file", "left_semi").select("kind", "code", "file", "line")


@query("baseline_new_only", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE NOT (code = 'redos' AND file LIKE 'repo1/%') AND NOT (code = 'insecure-cookie' AND file LIKE 'repo2/%')")
def baseline_new_only(spark, sf):
    """Entries of the old form know a finding by its fingerprint, those of the new form by the lines around it wherever they moved."""
    f = once(spark, sf)
    with_hash = f.join(P.context_hash(f, repositories(spark, sf)), ["kind", "code", "file", "line"])
    old = f.where("code = 'redos' and file like 'repo1/%'").select(P.v1_fingerprint().alias("fingerprint"), F.lit(None).cast("string").alias("context_hash"))
    moved = with_hash.where("code = 'insecure-cookie' and file like 'repo2/%'").select(F.lit("elsewhere").alias("fingerprint"), "context_hash")
    return P.not_in_baseline(with_hash, old.unionAll(moved)).select("kind", "code", "file", "line")


@query("line_collapse", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE NOT (code = 'debug-print' AND text LIKE '%eval(%')")
def line_collapse(spark, sf):
    """Findings of evaluation calls hide the plainer ones of their line."""
    f = once(spark, sf)
    strong = f.where("code = 'unsafe-eval'").select("file", "line").distinct()
    return f.where("code = 'unsafe-eval'").unionByName(f.where("code <> 'unsafe-eval'").join(strong, ["file", "line"], "left_anti")).select("kind", "code", "file", "line")


LESS = "CASE {c} WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE {c} END"


@query("noise_reduction", f"""{FOUND_SQL} SELECT kind, code, file, line, CASE WHEN k % 4 = 3 THEN {LESS.format(c='severity')} ELSE severity END AS severity,
 CASE WHEN k % 4 = 3 THEN {LESS.format(c='confidence')} ELSE confidence END AS confidence FROM findings WHERE NOT (k % 4 = 3 AND confidence = 'low')""")
def noise_reduction(spark, sf):
    return P.quieter(found(spark, sf)).select("kind", "code", "file", "line", "severity", "confidence")


@query("ignored_paths", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE k % 4 <> 3 AND file NOT LIKE 'repo4/%' AND file NOT LIKE '%.txt'")
def ignored_paths(spark, sf):
    return P.outside(found(spark, sf), ["docs", "repo4/", "*.txt", "nowhere/at/all"]).select("kind", "code", "file", "line")


@query("threshold", f"{FOUND_SQL} SELECT kind, code, file, line FROM findings WHERE severity IN ('high', 'medium') AND confidence = 'high'")
def threshold(spark, sf):
    return P.at_least(found(spark, sf), "medium", "high").select("kind", "code", "file", "line")


@query("configured", f"{FOUND_SQL} SELECT kind, code, file, line, CASE code WHEN 'debug-print' THEN 'high' ELSE severity END AS severity FROM findings WHERE code <> 'redos' AND NOT (code = 'jwt-misuse' AND file LIKE 'repo3/%')")
def configured(spark, sf):
    return P.configured(found(spark, sf), SETTINGS).select("kind", "code", "file", "line", "severity")


SETTINGS = {"debug-print": {"severity": "high"}, "redos": {"enabled": False}, "jwt-misuse": {"exclude": ["repo3/**"]}}
DIRECTIVES = [
    "// sast-ignore injection-flaw\ndb.query(\n  'a;' + id,\n);\ndb.query('b' + id);", "// sast-ignore-next-line\n\n// note\nlet a = f(1);\nlet b;",
    "/* sast-ignore redos */ let x = [\n1,\n];\nlet y = 1;", "let a = 1;\nlet b = 'sast';", "let a = 1;\n// sast-ignore last",
]


def directive_files(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return spread(table(spark, sf, "orders").select(key), "o_orderkey").select(F.concat(F.lit("o"), key.cast("string"), F.lit(".ts")).alias("path"), F.element_at(F.array(*map(F.lit, DIRECTIVES)), (key % 5 + 1).cast("int")).alias("content"))


@query("suppression_windows", """SELECT 'o' || o_orderkey || '.ts' AS file, line, code FROM orders JOIN (VALUES (0, 2, 'injection-flaw'), (0, 3, 'injection-flaw'), (0, 4, 'injection-flaw'), (1, 4, '*'), (2, 2, 'redos'), (2, 3, 'redos')) v(m, line, code)
 ON o_orderkey % 5 = m""")
def suppression_windows(spark, sf):
    return suppressions.windows(directive_files(spark, sf))


@query("suppression_adjacent", "SELECT 'o' || o_orderkey || '.ts' AS file, line, code FROM orders JOIN (VALUES (0, 1, 'injection-flaw'), (0, 2, 'injection-flaw'), (1, 2, '*'), (4, 2, 'last'), (4, 3, 'last')) v(m, line, code) ON o_orderkey % 5 = m")
def suppression_adjacent(spark, sf):
    return suppressions.adjacent(directive_files(spark, sf))


@query("suppressions_by_rule", "SELECT 'x' AS code, count(*) AS n, count(*) >= 5 AS review FROM orders WHERE o_orderkey % 5 = 1 HAVING count(*) > 0")
def suppressions_by_rule(spark, sf):
    f = directive_files(spark, sf).select(F.col("path").alias("file"), F.lit("x").alias("code"), F.explode(F.array(F.lit(4), F.lit(5))).alias("line"))
    return suppressions.hits(f, suppressions.windows(directive_files(spark, sf)))


# both scanners' steps in order

def marked(spark, sf) -> DataFrame:
    """Repositories where every eighth supplier's files start with a directive for the next statement."""
    f = repositories(spark, sf)
    return f.withColumn("content", F.when(F.col("k").cast("int") % 8 == 4, F.concat(F.lit("// sast-ignore-next-line\n"), "content")).otherwise(F.col("content")))


MARKED_SQL = f"{FOUND_SQL}, marked AS (SELECT * REPLACE (line + CASE WHEN k % 8 = 4 THEN 1 ELSE 0 END AS line), line AS was FROM findings)"


@query("scan_mobile_order", f"""{MARKED_SQL} SELECT kind, code, file, line, CASE code WHEN 'debug-print' THEN 'high' ELSE severity END AS severity FROM marked
 WHERE code <> 'redos' AND NOT (code = 'jwt-misuse' AND file LIKE 'repo3/%') AND NOT (k % 8 = 4 AND was = 1) AND NOT (code = 'email-address' AND file LIKE 'repo4/%')""")
def scan_mobile_order(spark, sf):
    files = marked(spark, sf)
    f = cut(rules.run(files, S.FOUND).select(*COLUMNS, "col"))
    known = reports.baseline(f.where("code = 'email-address' and file like 'repo4/%'"))
    return P.mobile_order(f, suppressions.adjacent(files), SETTINGS, known).select("kind", "code", "file", "line", "severity")


@query("scan_web_order", f"""{MARKED_SQL}, quiet AS (SELECT * REPLACE (CASE WHEN k % 4 = 3 THEN {LESS.format(c='severity')} ELSE severity END AS severity) FROM marked WHERE NOT (k % 4 = 3 AND confidence = 'low'))
SELECT kind, code, file, line, severity FROM quiet WHERE NOT (k % 8 = 4 AND (was = 1 OR file LIKE '%.txt')) AND file NOT LIKE 'repo7/%' AND k % 5 <> 2 AND code <> 'debug-print'
 AND NOT (code = 'redos' AND file LIKE 'repo1/%') AND NOT (code = 'insecure-cookie' AND file LIKE 'repo2/%') AND severity IN ('high', 'medium')""")
def scan_web_order(spark, sf):
    files = marked(spark, sf)
    f = cut(rules.run(files, S.FOUND).select(*COLUMNS, "col"))
    f = f.join(P.context_hash(f, files), ["kind", "code", "file", "line"])
    entries = f.where("code = 'redos' and file like 'repo1/%'").select(P.v1_fingerprint().alias("fingerprint"), F.lit(None).cast("string").alias("context_hash"))
    entries = entries.unionAll(f.where("code = 'insecure-cookie' and file like 'repo2/%'").select(F.lit("moved").alias("fingerprint"), "context_hash"))
    old = f.where("code = 'debug-print'").select(F.concat_ws(":", "code", "file", F.col("line").cast("string")).alias("key"))
    changed = files.where("cast(k as int) % 5 <> 2").select(F.col("path").alias("file"))
    return P.web_order(f, suppressions.windows(files), ["repo7/"], changed, old, entries, ("medium", None)).select("kind", "code", "file", "line", "severity")


@query("merged_reports", f"{FOUND_SQL} SELECT code, count(*) * 2 AS n, count(DISTINCT file) AS files FROM findings GROUP BY code")
def merged_reports(spark, sf):
    f = found(spark, sf)
    return P.merged([f, f]).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


# more aggregates

@query("rule_performance", f"{FOUND_SQL}, repos AS (SELECT count(DISTINCT s_suppkey % 10) AS r FROM supplier) SELECT code, count(*) AS total, round(count(*) / any_value(r), 1) AS per_repo, count(DISTINCT {REPO}) AS repos FROM findings, repos GROUP BY code")
def rule_performance(spark, sf):
    """The mean is over all repositories, those without findings too."""
    every = repositories(spark, sf).agg(F.count_distinct(F.split("path", "/")[0]).alias("r"))
    per = found(spark, sf).withColumn("repo", F.split("file", "/")[0]).groupBy("code").agg(F.count("*").alias("total"), F.count_distinct("repo").alias("repos"))
    return per.crossJoin(F.broadcast(every)).select("code", "total", F.round(F.col("total") / F.col("r"), 1).alias("per_repo"), "repos")


@query("run_percentiles_last50", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM (
  SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY event_type""")
def run_percentiles_last50(spark, sf):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 50")
    pct = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(p * 100)}")
    return last.groupBy("event_type").agg(pct(0.5), pct(0.95), pct(0.99))


@query("success_rate", """SELECT lane, CASE WHEN tried = 0 THEN 100.0 ELSE round(100.0 * (tried - failed) / tried) END AS rate, failed FROM (SELECT user_id % 10 AS lane, count(*) FILTER (event_type IN ('view', 'error')) AS tried,
 count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)""")
def success_rate(spark, sf):
    tried, failed = F.count_if(F.col("event_type").isin("view", "error")), F.count_if(F.col("event_type") == "error")
    per = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("lane")).agg(tried.alias("tried"), failed.alias("failed"))
    return per.select("lane", F.when(F.col("tried") == 0, F.lit(100.0)).otherwise(F.round(100.0 * (F.col("tried") - F.col("failed")) / F.col("tried"))).alias("rate"), "failed")


@query("skipped_largest", "SELECT path, n_bytes FROM (SELECT source || '/' || doc_id AS path, strlen(text) AS n_bytes FROM documents) ORDER BY n_bytes DESC, path LIMIT 5")
def skipped_largest(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("n_bytes")).orderBy(F.desc("n_bytes"), "path").limit(5)


@query("cwe_global", f"{FOUND_SQL} SELECT DISTINCT cwe FROM findings WHERE cwe <> '' ORDER BY cwe")
def cwe_global(spark, sf):
    return found(spark, sf).where("cwe <> ''").select("cwe").distinct().orderBy("cwe")


@query("sarif_rules", f"{FOUND_SQL} SELECT code, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS rule_index, n FROM (SELECT code, count(*) AS n, min(({RANK}, file, line, message, code, kind, text)) AS first FROM findings GROUP BY code)")
def sarif_rules(spark, sf):
    return reports.rule_index(found(spark, sf)).select("code", "rule_index", "n")


GITLAB = "CASE WHEN severity = 'high' AND confidence = 'high' THEN 'blocker' WHEN severity = 'high' THEN 'critical' WHEN severity = 'medium' THEN 'major' WHEN severity = 'low' THEN 'minor' ELSE 'info' END"
SECURE = "CASE WHEN severity = 'high' AND confidence = 'high' THEN 'Critical' WHEN severity = 'high' THEN 'High' WHEN severity = 'medium' AND confidence = 'low' THEN 'Low' WHEN severity = 'medium' THEN 'Medium' WHEN severity = 'low' THEN 'Low' ELSE 'Info' END"
CLOUD = "CASE WHEN severity = 'high' AND confidence = 'high' THEN 'CRITICAL' WHEN severity = 'high' THEN 'HIGH' WHEN severity = 'medium' THEN 'MEDIUM' ELSE 'LOW' END"


@query("gitlab_rows", f"{FOUND_SQL} SELECT sha1(code || '|' || file || '|' || line || '|' || message) AS fingerprint, {GITLAB} AS severity, {SECURE} AS security FROM findings")
def gitlab_rows(spark, sf):
    s, c = F.col("severity"), F.col("confidence")
    return found(spark, sf).select(F.sha1(F.concat_ws("|", "code", "file", F.col("line").cast("string"), "message")).alias("fingerprint"), X.gitlab_severity(s, c).alias("severity"), X.gitlab_security_severity(s, c).alias("security"))


@query("bitbucket_rows", f"{FOUND_SQL} SELECT code || '-' || (row_number() OVER (ORDER BY {ORDER}) - 1) AS id, {CLOUD} AS severity FROM findings ORDER BY {ORDER} LIMIT 1000")
def bitbucket_rows(spark, sf):
    # the sink takes a thousand annotations, so the numbering runs over these alone
    top = P.top_n(found(spark, sf), 1000)
    n = F.row_number().over(Window.orderBy(*P.order())) - 1
    return top.select(F.concat(F.col("code"), F.lit("-"), n.cast("string")).alias("id"), X.bitbucket_severity(F.col("severity"), F.col("confidence")).alias("severity"))


@query("html_rows", f"""{FOUND_SQL} SELECT '<tr class="' || severity || '"><td>' || severity || '</td><td>' || code || '</td><td>' || file || ':' || line || '</td><td>' || message || '</td><td><code>' ||
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '</code></td></tr>' AS row FROM findings""")
def html_rows(spark, sf):
    return found(spark, sf).select(reports.html_row().alias("row"))


@query("console_rows", f"{FOUND_SQL} SELECT '[' || upper(severity) || '] ' || code || ' ' || file || ':' || line || chr(10) || '  ' || message AS row FROM findings")
def console_rows(spark, sf):
    return found(spark, sf).select(reports.console_row().alias("row"))


@query("json_rows", f"""{FOUND_SQL} SELECT code, json_extract_string(j, '$.filePath') AS file, CAST(json_extract(j, '$.line') AS INTEGER) AS line FROM (SELECT code, to_json({{'filePath': file, 'line': line}}) AS j FROM findings)""")
def json_rows(spark, sf):
    j = found(spark, sf).select("code", reports.json_row().alias("j"))
    return j.select("code", F.get_json_object("j", "$.filePath").alias("file"), F.get_json_object("j", "$.line").cast("int").alias("line"))


@query("baseline_entries", f"{FOUND_SQL} SELECT DISTINCT code, file, message, code || '|' || file || '|' || substr(message, 1, 60) AS v1 FROM findings ORDER BY code, file, message")
def baseline_entries(spark, sf):
    return found(spark, sf).select("code", "file", "message", P.v1_fingerprint().alias("v1")).distinct().orderBy("code", "file", "message")
