"""Report documents from findings. Rows are made by executors; a document is one aggregate of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as X
from vigilake.operators import findings as P


def rule_index(found: DataFrame) -> DataFrame:
    """code, rule_index (from 0, by first appearance in report order), n, cwes of every code."""
    per = found.groupBy("code").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(P.order())))).alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("cwe") != "", F.col("cwe")))).alias("cwes"))
    return per.withColumn("rule_index", F.row_number().over(Window.orderBy("first")) - 1).drop("first")


def sarif(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row, one column: a SARIF 2.1.0 document with rule indexes, CWE taxonomy, code flows and, against known(fingerprint), baseline states.

    found may carry trace (array<string>); a finding without one has a flow of its own place alone."""
    s, c = F.col("severity"), F.col("confidence")
    rows = found if "trace" in found.columns else found.withColumn("trace", F.lit(None).cast("array<string>"))
    index = rule_index(found)
    rows = rows.join(F.broadcast(index.select("code", "rule_index")), "code").withColumn("_f", P.fingerprint())
    if known is None:
        rows = rows.withColumn("_state", F.lit(None).cast("string"))
    else:
        rows = rows.join(known.select(F.col("fingerprint").alias("_f"), F.lit("unchanged").alias("_s")).distinct(), "_f", "left").withColumn("_state", F.coalesce("_s", F.lit("new")))
    region = F.struct(F.col("line").alias("startLine"), F.struct(X.clamp(F.col("text")).alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    step = lambda t: F.struct(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"), F.struct(t.alias("text")).alias("message")).alias("location"))
    steps = F.transform(F.coalesce("trace", F.array("message")), step)
    result = F.struct(
        F.col("code").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.lit("fail").alias("kind"), X.sarif_level(s).alias("level"), X.sarif_rank(s, c).alias("rank"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("_f").alias("primary")).alias("partialFingerprints"), F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))).alias("codeFlows"), F.col("_state").alias("baselineState"),
    )
    keys = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(P.order())))
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), result.alias("r")))), lambda x: x["r"]).alias("results"))
    about = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "code", "cwes"))), lambda x: F.struct(x["code"].alias("id"), F.struct(x["cwes"].alias("cwe")).alias("properties"))).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwes")))).alias("taxa"))
    driver = F.struct(F.lit("vigilake").alias("name"), F.col("rules"))
    taxonomy = F.struct(F.lit("CWE").alias("name"), F.transform("taxa", lambda x: F.struct(x.alias("id"))).alias("taxa"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.array(taxonomy).alias("taxonomies"), F.col("results"))
    return one.crossJoin(about).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def sarif_keys(spark, path: str) -> DataFrame:
    """code:uri:line and all partial fingerprints of a SARIF file, for anti joins."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "runs array<struct<results:array<struct<ruleId:string,partialFingerprints:map<string,string>,"
        "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>>>>>").alias("d")).select(F.explode("d.runs").alias("r")).select(F.explode("r.results").alias("x"))
    at = F.col("x.locations")[0]["physicalLocation"]
    where = F.concat_ws(":", "x.ruleId", at["artifactLocation"]["uri"], at["region"]["startLine"].cast("string"))
    return raw.select(where.alias("key")).unionAll(raw.select(F.explode(F.map_values("x.partialFingerprints")).alias("key"))).distinct()


def json_row() -> Column:
    return F.to_json(F.struct("code", "severity", "confidence", "category", "cwe", "message", F.col("file").alias("filePath"), "line"))


def json_report(found: DataFrame) -> DataFrame:
    """One row: counts, taken before any cut to a top, and the findings in report order."""
    keys = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(P.order())))
    return found.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in X.SEVERITIES), F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), json_row().alias("j")))), lambda x: x["j"]).alias("findings"))


def console_row() -> Column:
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "code", F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"), F.lit("\n  "), "message")


def html_row() -> Column:
    cells = [F.col("severity"), F.col("code"), F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string")), F.col("message"), F.concat(F.lit("<code>"), X.html_text(F.col("text")), F.lit("</code>"))]
    cells = [c if i == 4 else X.html_text(c) for i, c in enumerate(cells)]
    return F.concat(F.lit('<tr class="'), "severity", F.lit('"><td>'), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))


def html(found: DataFrame, title: str = "Findings") -> DataFrame:
    """Lines of one self-contained page: head, a row a finding in report order, foot. Rows stay distributed until they are written."""
    spark = found.sparkSession
    rows = found.select(F.lit(1).alias("part"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(P.order()))).alias("k"), html_row().alias("value"))
    edge = spark.createDataFrame([(0, f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><h1>{title}</h1><table>"), (2, "</table></body></html>")], "part int, value string")
    return rows.unionByName(edge, allowMissingColumns=True).orderBy("part", "k").select("value")


def junit(found: DataFrame, skipped: DataFrame) -> DataFrame:
    """Lines of a JUnit document: a failed case for each finding and a skipped one for each skipped(path)."""
    spark = found.sparkSession
    case = F.format_string('<testcase classname="%s" name="%s:%d"><failure message="%s"/></testcase>', "code", X.xml_text(F.col("file")), "line", X.xml_text(F.col("message")))
    n, m = found.count(), skipped.count()
    rows = found.select(F.lit(1).alias("part"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(P.order()))).alias("k"), case.alias("value"))
    more = skipped.select(F.lit(2).alias("part"), F.format_string('<testcase classname="skipped" name="%s"><skipped/></testcase>', X.xml_text(F.col("path"))).alias("value"))
    edge = spark.createDataFrame([(0, f'<testsuite name="vigilake" tests="{n + m}" failures="{n}" skipped="{m}">'), (3, "</testsuite>")], "part int, value string")
    return rows.unionByName(more, allowMissingColumns=True).unionByName(edge, allowMissingColumns=True).orderBy("part", "k", "value").select("value")


CSV_COLUMNS = ["severity", "code", "category", "confidence", "file", "line", "col", "message", "cwe", "text"]


def csv_lines(found: DataFrame) -> DataFrame:
    """Header and rows of a CSV file; write them as text with lineSep \\r\\n."""
    rows = found if "col" in found.columns else found.withColumn("col", F.lit(None).cast("int"))
    fields = F.concat_ws(",", *(X.csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in CSV_COLUMNS))
    body = rows.select(F.lit(1).alias("part"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(P.order()))).alias("k"), fields.alias("value"))
    head = found.sparkSession.createDataFrame([(0, ",".join(CSV_COLUMNS))], "part int, value string")
    return body.unionByName(head, allowMissingColumns=True).orderBy("part", "k").select("value")


VERSION = 2


def baseline(found: DataFrame) -> DataFrame:
    """fingerprint, code, file, message, each once."""
    return found.select(P.fingerprint().alias("fingerprint"), "code", "file", "message").distinct()


def baseline_document(entries: DataFrame) -> DataFrame:
    """One row: a versioned JSON document of entries(code, file, line, fingerprint, context_hash) in order."""
    one = entries.agg(F.array_sort(F.collect_list(F.struct("code", "file", "line", "fingerprint", "context_hash"))).alias("entries"))
    return one.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "entries")).alias("value"))


def read_baseline(spark, path: str) -> DataFrame:
    """Entries of a baseline file of version 1 or 2; none where there is no file, an error where the version is newer."""
    schema = "version int, entries array<struct<code:string,file:string,line:int,fingerprint:string,context_hash:string>>"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "code string, file string, line int, fingerprint string, context_hash string")
    doc = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    version = doc.agg(F.max("version")).first()[0]
    if version is None or version > VERSION:
        raise ValueError(f"a baseline of version {version} is not known")
    return doc.select(F.explode("entries").alias("e")).select("e.*")


def new_since(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", P.fingerprint()).join(known.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*found.columns)
