"""Sources: JSON lines, index bundles, listings, markup, PDF files, id lists, benchmarks, releases.

Missing paths give empty frames with the declared schema; nothing infers a schema from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Validated rows (FAILFAST), tolerant rows (PERMISSIVE) or without corrupt rows (DROPMALFORMED); blank lines are none."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("mode", mode).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else empty(spark, schema)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, vector array<float>) of an index bundle."""
    return parquet_table(spark, path, "item_id string, vector array<float>, encoder_model string, vector_dim int")


def with_precedence(raw: DataFrame, normalised: DataFrame, key: str) -> DataFrame:
    """Normalised rows, and raw rows of ids that have none."""
    return normalised.unionByName(raw.join(normalised.select(key), key, "left_anti"), allowMissingColumns=True)


def lookup(raw: DataFrame, normalised: DataFrame, key: str, value: str) -> DataFrame:
    """At most one row of an id, normalised before raw; the filter reaches both scans."""
    hit = normalised.where(F.col(key) == value).withColumn("_p", F.lit(0)).unionByName(raw.where(F.col(key) == value).withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return hit.orderBy("_p").limit(1).drop("_p")


def listings(pages: DataFrame) -> DataFrame:
    """(listing_id, title, url) of conference listing pages (url, html): anchors to papers, the last row of an id
    counts, front matter (ids ending in .0) is left out."""
    link = r"""(?is)<a\s[^>]*href="(/?[\w./-]*?/?([A-Za-z0-9]+[-.][\w.-]*?\d+)/?)"[^>]*>(.*?)</a>"""
    hits = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(link), F.lit(0))).alias("pos", "a"))
    one = hits.select("url", "pos", F.regexp_extract("a", link, 1).alias("path"), F.regexp_extract("a", link, 2).alias("listing_id"), X.html_text(F.regexp_extract("a", link, 3)).alias("title"))
    kept = one.where(~F.col("listing_id").rlike(r"[.-]0$") & (F.col("title") != ""))
    return kept.groupBy("listing_id").agg(F.max_by(F.struct("title", "path"), F.struct("url", "pos")).alias("s")).select("listing_id", "s.title", F.col("s.path").alias("url"))


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("url", X.page_title("html").alias("title"))


def header_tei(files: DataFrame) -> DataFrame:
    """(path, title, affiliations, authors) of TEI header documents (path, xml), by built-in XPath.

    Malformed documents give nulls and empty arrays.
    """
    x = F.regexp_replace("xml", r"""\sxmlns(:\w+)?="[^"]*"|(?<=<|</)\w+:""", "")
    well = F.when(x.rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*<TEI\b.*</TEI>\s*$"), x)
    d = files.select("path", well.alias("x"))
    title = F.nullif(X.squash(F.expr("xpath_string(x, '//teiHeader//titleStmt/title[1]')")), F.lit(""))
    return d.select(
        "path",
        title.alias("title"),
        F.array_distinct(F.expr("xpath(x, '//teiHeader//affiliation/orgName[@type=\"institution\"]/text()')")).alias("affiliations"),
        F.expr("xpath(x, '//teiHeader//author/persName/surname/text()')").alias("surnames"),
    )


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified): PDF files below a folder, each once; contents are not read."""
    if not exists(spark, path):
        return empty(spark, "path string, length bigint, modified timestamp")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return df.select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def pdf_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, path, length, title) of files that carry the PDF signature; the id is the content's SHA-256."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    ok = df.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return ok.select(F.concat(F.lit("personal-"), F.substring(F.sha2("content", 256), 1, 16)).alias("paper_id"), "path", "length", X.title_from_path("path").alias("title")).dropDuplicates(["paper_id"])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, id): one id a line, comments and repeats left out, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    ids = lines.select("pos", F.trim(F.regexp_replace("line", "#.*", "")).alias("id")).where("id <> ''")
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("pos"))).select("position", "id")


def catalogue(manifest: DataFrame) -> DataFrame:
    """(corpus_key, venue, year, track, build_id): keys of the form venue/year/track; malformed ones are skipped."""
    p = F.split("corpus_key", "/")
    ok = manifest.where((F.size(p) == 3) & p[1].try_cast("int").isNotNull())
    return ok.select("corpus_key", p[0].alias("venue"), p[1].cast("int").alias("year"), p[2].alias("track"), "build_id")


def completed_releases(states: DataFrame, required: list[str], files: DataFrame) -> DataFrame:
    """Releases whose state is completed and that hold every required file. files: (corpus_key, name)."""
    n = files.where(F.col("name").isin(required)).groupBy("corpus_key").agg(F.countDistinct("name").alias("n"))
    return states.where("status = 'completed'").join(n, "corpus_key").where(F.col("n") == len(set(required))).drop("n")


def open_failures(failures: DataFrame, completed: DataFrame) -> DataFrame:
    """The latest failure of each paper that has not been completed since."""
    last = failures.groupBy("paper_id").agg(F.max_by(F.struct("stage", "error_type", "error_message", "failed_at"), "failed_at").alias("s")).select("paper_id", "s.*")
    return last.join(completed.select("paper_id"), "paper_id", "left_anti")


def paper_search_benchmark(raw: DataFrame) -> DataFrame:
    """(query_id, query, target) of rows (id, question, paper_ids): one row a relevant paper."""
    return raw.select(F.col("id").cast("string").alias("query_id"), X.squash("question").alias("query"), F.explode("paper_ids").alias("target")).where("query <> ''")


def review_qa_benchmark(qa: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, paper_id, query, gold_answers, gold_evidence): QA rows with the distinct augmented answers."""
    a = answers.groupBy("query_id").agg(F.array_sort(F.collect_set(F.nullif(X.squash("answer"), F.lit("")))).alias("extra"))
    j = qa.join(a, "query_id", "left")
    nothing = F.array().cast("array<string>")
    gold = F.array_distinct(F.filter(F.concat(F.coalesce("answers", nothing), F.coalesce("extra", nothing)), lambda x: x.isNotNull() & (x != "")))
    return j.select("query_id", "paper_id", X.squash("question").alias("query"), gold.alias("gold_answers"), F.array_distinct(F.coalesce("evidence", nothing)).alias("gold_evidence"))


def nested_qa_benchmark(docs: DataFrame) -> DataFrame:
    """(query_id, paper_id, query, answer, answerable) of documents (paper_id, json) with nested questions and answers."""
    schema = "qas array<struct<question_id string, question string, answers array<struct<answer struct<unanswerable boolean, free_form_answer string, extractive_spans array<string>, yes_no boolean>>>>>"
    q = docs.select("paper_id", F.explode(F.from_json("json", schema)["qas"]).alias("q"))
    a = q.select("paper_id", F.col("q.question_id").alias("query_id"), X.squash("q.question").alias("query"), F.posexplode_outer("q.answers").alias("n", "a"))
    ans = F.col("a.answer")
    text = F.coalesce(F.nullif(X.squash(ans["free_form_answer"]), F.lit("")), F.nullif(F.array_join(ans["extractive_spans"], " "), F.lit("")), F.when(ans["yes_no"], "Yes").when(~ans["yes_no"], "No"))
    return a.select("query_id", "paper_id", "query", F.col("n").alias("answer_no"), text.alias("answer"), (~F.coalesce(ans["unanswerable"], F.lit(False))).alias("answerable"))


def layout_blocks(files: DataFrame) -> DataFrame:
    """(paper_id, ordinal, page_idx, block_type, text, bbox) of layout documents (paper_id, json)."""
    from folioscope.sources.markup import nested_text

    # a block is kept as JSON text: where its own text stands differs by type
    schema = "pdf_info array<struct<page_idx int, para_blocks array<string>>>"
    pages = files.select("paper_id", F.explode(F.from_json("json", schema)["pdf_info"]).alias("p"))
    blocks = pages.select("paper_id", (F.col("p.page_idx") + 1).alias("page_idx"), F.posexplode("p.para_blocks").alias("n", "b"))
    box = F.from_json(F.get_json_object("b", "$.bbox"), "array<double>")
    blocks = blocks.select("*", F.get_json_object("b", "$.type").alias("type"), F.when(F.size(box) >= 4, F.slice(box, 1, 4)).otherwise(F.array().cast("array<double>")).alias("bbox"))
    kind = X.block_type("type")
    kept = blocks.where(~kind.isin("discarded", "abandon", "header", "footer", "page_number", "page_header", "page_footer", "footnote"))
    w = Window.partitionBy("paper_id").orderBy("page_idx", "n")
    return kept.select("paper_id", (F.row_number().over(w) - 1).alias("ordinal"), "page_idx", kind.alias("block_type"), nested_text("b").alias("text"), "bbox")


def markdown_sections(docs: DataFrame, key: str, markdown: str, stop: list[str] = ("references", "bibliography", "acknowledgements", "acknowledgments")) -> DataFrame:
    """(key, section_no, level, heading, text) of Markdown texts; text before the first heading is section 0;
    a stop heading ends the document."""
    lines = docs.select(key, F.posexplode(F.split(markdown, r"\r?\n")).alias("pos", "line"))
    m = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    lines = lines.withColumn("mark", F.length(F.regexp_extract("line", m, 1))).withColumn("heading", F.when(F.col("mark") > 0, F.regexp_extract("line", m, 2)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = F.lower(F.regexp_replace("heading", r"^[\d.]+\s*", ""))
    lines = lines.withColumn("section_no", F.sum((F.col("mark") > 0).cast("int")).over(w)).withColumn("stopped", F.max(F.coalesce(bare.isin(list(stop)), F.lit(False)).cast("int")).over(w)).where("stopped = 0")
    body = F.array_sort(F.collect_list(F.when(F.col("mark") == 0, F.struct("pos", "line"))))
    return lines.groupBy(key, "section_no").agg(F.max("mark").alias("level"), F.max("heading").alias("heading"), F.trim(F.array_join(F.transform(body, lambda s: s["line"]), "\n")).alias("text"))
