"""Files as rows: from a source tree, from documents and from web pages; and the lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_FOLDERS = ("build", ".git", ".dart_tool", "node_modules", "dist", "out", "coverage", ".idea", "Pods")
EXTENSIONS = ("dart", "sql", "yaml", "yml", "json", "xml", "plist", "gradle", "pro", "ts", "tsx", "js", "jsx", "html", "md", "env", "py", "kt", "java", "swift", "toml", "properties", "rs")
MOST_BYTES = 2 << 20


def decoded(content: Column) -> Column:
    """Text of a file: byte order mark gone, line ends as \\n; empty if it is too long or in UTF-16 or UTF-32."""
    head = F.hex(F.substring(content, 1, 4))
    wide = head.startswith("FEFF") | head.startswith("FFFE") | (head == "0000FEFF")
    text = F.regexp_replace(F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""), "\r\n?", "\n")
    return F.when(wide | (F.length(content) > MOST_BYTES), F.lit("")).otherwise(text)


def read_tree(spark: SparkSession, root: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """files(path, name, ext, content, n_bytes) below root, and the files skipped for their size (path, n_bytes)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    if dots := _dot_files(spark, root, most):
        raw = raw.unionByName(spark.createDataFrame(dots, raw.schema))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    raw = raw.select(rel.alias("path"), "length", "content").where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    name = F.element_at(F.split("path", "/"), -1)
    raw = raw.select("path", name.alias("name"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext"), "length", "content")
    raw = raw.where(F.col("ext").isin(*EXTENSIONS) | F.col("name").startswith(".env") | (F.col("name") == ".gitignore"))
    files = raw.where(F.col("length") <= most).select("path", "name", "ext", decoded(F.col("content")).alias("content"), F.col("length").alias("n_bytes"))
    return files, raw.where(F.col("length") > most).select("path", F.col("length").alias("n_bytes"))


def _dot_files(spark: SparkSession, root: str, most: int) -> list[tuple[str, int, bytearray]]:
    """Environment and ignore files. Spark's readers pass over names that start with a dot, so the driver reads these few
    small files; of one over the size limit only the length is taken."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = [], fs.listFiles(path, True)
    while listing.hasNext():
        status = listing.next()
        f, size = status.getPath(), status.getLen()
        if f.getName().startswith(".env") or f.getName() == ".gitignore":
            stream = fs.open(f)
            body = bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) if size <= most else bytearray()
            stream.close()
            found.append((f.toString(), size, body))
    return found


def files_from_documents(docs: DataFrame) -> DataFrame:
    """path = source/doc_id.lang, content = text."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return docs.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def files_from_pages(pages: DataFrame) -> DataFrame:
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return pages.select(path.alias("path"), F.coalesce("html", F.lit("")).alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), text."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line_no"), "text")


FILES_SQL = """files AS (
  SELECT source || '/' || doc_id || '.' || lang AS path, coalesce(text, '') AS content FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.html', coalesce(html, '') FROM pages)"""
