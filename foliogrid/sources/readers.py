"""Sources and sinks: JSON lines, glossaries, annotations, LaTeX trees, logs, SyncTeX output, glyph names and file hashes.

Everything is read and written through Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliogrid.session import cut


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """Objects of a JSON-lines file; blank and broken lines and other values are left out. ``limit``: a feature of the reader."""
    text = spark.read.text(path).where("trim(value) <> '' and startswith(trim(value), '{')")
    kept = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o"), "value").where("o is not null and try_parse_json(value) is not null").select("o.*")
    return kept.limit(limit) if limit is not None else kept


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


TERM = "struct<en:string,zh:string,domain:string,force:boolean,aliases:array<string>,notes:string>"


def glossary_file(spark: SparkSession, path: str) -> DataFrame:
    """Terms of JSON files: a list of terms, or an object with ``terms``; the file's name is the domain by default.

    Terms without both languages are left out, unreadable files too.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), "value")
    listed = F.from_json("value", f"array<{TERM}>")
    held = F.from_json("value", f"struct<domain:string,terms:array<{TERM}>>")
    both = files.select("stem", F.when(F.ltrim("value").startswith("["), listed).otherwise(held["terms"]).alias("terms"), held["domain"].alias("own"))
    terms = both.select("stem", "own", F.explode("terms").alias("t"))
    out = terms.select(F.coalesce("t.domain", "own", "stem").alias("domain"), "t.en", "t.zh", F.coalesce("t.force", F.lit(False)).alias("force"), F.coalesce("t.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("t.notes", F.lit("")).alias("notes"))
    return out.where("trim(coalesce(en, '')) <> '' and trim(coalesce(zh, '')) <> ''")


def glossary_csv(spark: SparkSession, path: str, domain: str = "") -> DataFrame:
    """Terms of a CSV file with a header; aliases are split at commas, ``force`` is true for ``true`` alone."""
    raw = spark.read.option("header", "true").csv(path)
    col = lambda name: F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")
    rows = raw.select(F.trim(col("en")).alias("en"), F.trim(col("zh")).alias("zh"), F.when(F.trim(col("domain")) == "", domain).otherwise(F.trim(col("domain"))).alias("domain"), (F.lower(F.trim(col("force"))) == "true").alias("force"), F.filter(F.transform(F.split(col("aliases"), ","), lambda a: F.trim(a)), lambda a: a != "").alias("aliases"), col("notes").alias("notes"))
    return rows.where("en <> '' and zh <> ''")


def import_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms by the file's kind; other kinds are an error."""
    if path.endswith(".csv"):
        return glossary_csv(spark, path)
    if path.endswith(".json"):
        return glossary_file(spark, path)
    raise ValueError(f"neither CSV nor JSON: {path}")


def glossary_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of all ``*.json`` in a folder."""
    return glossary_file(spark, f"{folder}/*.json")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(doc_hash, block_id, note) of a JSON store; broken stores are empty, blank notes left out, other values read as text."""
    text = spark.read.text(path, wholetext=True)
    docs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_hash", "notes"))
    notes = docs.select("doc_hash", F.explode(F.from_json("notes", "map<string,string>")).alias("block_id", "note"))
    return notes.select("doc_hash", "block_id", F.trim("note").alias("note")).where("note <> '' and trim(doc_hash) <> '' and trim(block_id) <> ''")


def patch_annotations(store: DataFrame, patches: DataFrame) -> DataFrame:
    """The store after patches (doc_hash, block_id, note): the patch counts, a blank note deletes."""
    new = patches.select("doc_hash", "block_id", F.coalesce(F.trim("note"), F.lit("")).alias("new"))
    both = store.join(new, ["doc_hash", "block_id"], "full_outer")
    return both.select("doc_hash", "block_id", F.coalesce("new", "note").alias("note")).where("note <> ''")


def annotation_json(store: DataFrame) -> DataFrame:
    """(doc_hash, notes as JSON): a document without notes has no row."""
    return store.groupBy("doc_hash").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_id", "note"))))).alias("notes"))


def tex_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all ``*.tex`` below a folder but those in ``build``; the path is relative to it."""
    base = root.rstrip("/")
    name = base.rsplit("/", 1)[-1]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").text(base, wholetext=True)
    rel = F.regexp_extract(F.input_file_name(), f"/{name}/(.*)$", 1)
    return files.select(rel.alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"(^|/)build/"))


def include_order(files: DataFrame, main: str, depth: int = 64) -> DataFrame:
    """(path, order) of the files reached from ``main``, depth first, each at its first visit.

    A file's place is the list of its include numbers from the main file on; level by level, names join files, and the least
    place counts. Lists compare like the visits, a file before what it includes.
    """
    clean = F.regexp_replace("text", r"(?<!\\)%[^\n]*", "")
    found = F.regexp_extract_all(clean, F.lit(r"\\(?:input|include)\s*\{([^}]+)\}"), F.lit(1))
    edges = files.select("path", F.posexplode(found).alias("k", "name")).select("path", "k", F.concat(F.regexp_replace(F.trim("name"), r"\.tex$", ""), F.lit(".tex")).alias("child"))
    edges = edges.join(files.select(F.col("path").alias("child")), "child")
    level = files.where(F.col("path") == main).select("path", F.array().cast("array<int>").alias("place"))
    seen = level
    for _ in range(depth):
        level = level.join(edges, "path").select(F.col("child").alias("path"), F.concat("place", F.array("k")).alias("place"))
        level = level.groupBy("path").agg(F.min("place").alias("place"))
        old = seen.withColumnRenamed("place", "old")
        level = level.join(old, "path", "left").where("old is null or place < old").select("path", "place")
        if level.isEmpty():
            break
        seen = seen.unionByName(level).groupBy("path").agg(F.min("place").alias("place"))
    return seen.select("path", F.expr("row_number() over (order by place) - 1").alias("order"))


def log_tail(spark: SparkSession, path: str, last: int = 1000) -> DataFrame:
    """(line, level, ms) of the last lines of a log, in order: a top-k of line places."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")).orderBy(F.desc("place")).limit(last)
    level = F.regexp_extract("line", r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b", 1)
    ms = F.expr(r"try_cast(regexp_extract(line, '(\\d+(?:\\.\\d+)?)\\s*ms', 1) as double)")
    return lines.select("place", "line", level.alias("level"), ms.alias("ms"))


def synctex_records(output: DataFrame, column: str = "value") -> DataFrame:
    """Rows of ``synctex view`` output: records open with ``Output:``; keys are Page, x, y, h, v, W, H."""
    body = F.regexp_extract(F.col(column), r"(?s)SyncTeX result begin\s*(.*?)\s*SyncTeX result end", 1)
    records = output.select(F.posexplode(F.split(body, r"(?=Output:)")).alias("place", "record")).where("trim(record) <> ''")
    field = lambda key: F.expr(f"try_cast(regexp_extract(record, '(?m)^{key}:\\\\s*(-?[0-9.]+)', 1) as double)")
    out = records.select("place", F.regexp_extract("record", r"(?m)^Output:\s*(.*)$", 1).alias("output"), field("Page").cast("int").alias("page"), *[field(k).alias(n) for k, n in (("x", "x"), ("y", "y"), ("h", "h"), ("v", "v"), ("W", "w"), ("H", "height"))])
    return out.where("page is not null")


def best_synctex(records: DataFrame, first: int, last: int) -> DataFrame:
    """The first record in a window of pages, else the first of all."""
    return records.groupBy().agg(F.expr(f"min_by(struct(*), struct(not (page between {first} and {last}), place))").alias("best")).select("best.*")


def glyph_names(spark: SparkSession, path: str, priority: int, source: str) -> DataFrame:
    """(name, unicode, priority, source) of a list with ``name;HEX HEX`` or ``name HEX`` lines; ``#`` opens a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = lines.select(F.regexp_extract("line", r"^([^;\s]+)[;\s]+((?:[0-9A-Fa-f]{4,6}[\s_]*)+)$", 1).alias("name"), F.regexp_extract("line", r"^([^;\s]+)[;\s]+((?:[0-9A-Fa-f]{4,6}[\s_]*)+)$", 2).alias("hex")).where("name <> ''")
    return parts.select("name", characters(F.col("hex")).alias("unicode"), F.lit(priority).alias("priority"), F.lit(source).alias("source"))


def characters(hexes: Column) -> Column:
    """The text that code points in hex spell."""
    units = F.transform(F.filter(F.split(F.trim(hexes), r"[\s_]+"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))
    four = lambda x: F.lpad(F.hex(x), 4, "0")
    utf16 = F.transform(units, lambda c: F.when(c < 65536, four(c)).otherwise(F.concat(four((55296 + F.floor((c - 65536) / 1024)).cast("int")), four((56320 + (c - 65536) % 1024).cast("int")))))
    return F.decode(F.unhex(F.array_join(utf16, "")), "utf-16be")


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, doc_hash) of files: the document's id is the first 16 digits."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256")).withColumn("doc_hash", F.substring("sha256", 1, 16))


def write_index(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the index of the documents in ``df`` and leave the others.

    Documents are dealt to ``buckets`` by a hash of their id; only the buckets that they fall into are written again, with the documents that stay, to
    a folder of their own first, as a folder can't be read while it is replaced.
    """
    spark = df.sparkSession
    own = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        touched = own.select("bucket").distinct()
        stay = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(own.select("doc_id").distinct(), "doc_id", "left_anti")
        own = cut(own.unionByName(stay.select(*own.columns)))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", buckets: int = 256) -> None:
    """A collection of vectors, as ``array<float>`` beside what else the rows have, kept by document as ``write_index`` does."""
    write_index(df.withColumn(vector, F.col(vector).cast("array<float>")), path, buckets)


def json_chunks(spark: SparkSession, path: str, schema: T.StructType | str, size: int = 512) -> DataFrame:
    """Objects of a JSON-lines file in chunks: (chunk, rows) with ``size`` rows at most, in the order of the file. Chunks end where a task's rows end."""
    rows = json_lines(spark, path, schema).select(F.struct("*").alias("r")).withColumn("id", F.monotonically_increasing_id())
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    grouped = rows.groupBy(part.alias("part"), F.floor(place / size).alias("no")).agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("rows"))
    return grouped.select(F.concat_ws("-", "part", "no").alias("chunk"), F.col("rows.r").alias("rows"))


def outline(entries: DataFrame) -> DataFrame:
    """(doc_id, level, title, page_num) of native outlines (doc_id, n, level, title, page), pages counted from 0; entries without a title or page go."""
    return entries.where("trim(coalesce(title, '')) <> '' and page >= 1").select("doc_id", "level", F.trim("title").alias("title"), (F.col("page") - 1).cast("int").alias("page_num"), "n")


def first_pages(df: DataFrame, pages: int = 8) -> tuple[DataFrame, DataFrame]:
    """The rows of the first pages, and the rest: two plans over one table, so that the first is there early. No row is in both."""
    return df.where(F.col("page_num") < pages), df.where(F.col("page_num") >= pages)


def needed_files(files: DataFrame, main: str, depth: int = 64) -> DataFrame:
    """(path, level) of the macro sources that a file needs, level by level: packages, classes and inputs that are among ``files`` (path, text).

    Packages are looked for as ``.sty``, classes as ``.cls``, inputs as ``.tex``; what isn't there is left out.
    """
    clean = F.regexp_replace("text", r"(?<!\\)%[^\n]*", "")
    found = lambda command, end: F.transform(F.flatten(F.transform(F.regexp_extract_all(clean, F.lit(rf"\\(?:{command})\s*(?:\[[^\]]*\])?\s*\{{([^}}]+)\}}"), F.lit(1)), lambda x: F.split(x, ","))), lambda x: F.concat(F.regexp_replace(F.trim(x), rf"\.{end}$", ""), F.lit(f".{end}")))
    names = F.concat(found("usepackage|RequirePackage", "sty"), found("documentclass|LoadClass", "cls"), found("input|include", "tex"))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    edges = files.select("path", F.explode(names).alias("name")).join(files.select(F.col("path").alias("child"), base.alias("name")), "name").select("path", "child").distinct()
    seen = level = files.where(F.col("path") == main).select("path", F.lit(0).alias("level"))
    for k in range(1, depth + 1):
        level = cut(level.join(edges, "path").select(F.col("child").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("level", F.lit(k)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def page_range(df: DataFrame, start: int, pages: int | None) -> DataFrame:
    """Rows of a range of pages; None or 0 is all from ``start`` on."""
    out = df.where(F.col("page_num") >= start)
    return out.where(F.col("page_num") < start + pages) if pages else out
