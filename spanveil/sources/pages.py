"""Pages of documents and OCR output (SRC3 to SRC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import decode_text


def split_pages(docs: DataFrame) -> DataFrame:
    """SRC3: doc_id, page_no, start, end, text of each page behind its marker; a document without markers is page 1."""
    rx = r"(?m)^## Página (\d+)[ \t]*\n?"
    numbers, parts, marks = F.regexp_extract_all("text", F.lit(rx), F.lit(1)), F.split("text", rx, -1), F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    out = docs.withColumn("__n", numbers).withColumn("__p", parts).withColumn("__m", marks)
    whole = F.array(F.struct(F.lit(1).alias("page_no"), F.lit(0).alias("start"), F.col("text").alias("text")))
    start = F.struct(F.length(F.col("__p")[0]).alias("at"), F.array().cast("array<struct<page_no:int,start:int,text:string>>").alias("out"))
    each = F.transform("__m", lambda m, i: F.struct(m.alias("m"), F.get("__n", i).alias("n"), F.get("__p", i + 1).alias("p")))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["m"])
        return F.struct((a + F.length(x["p"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["n"].cast("int").alias("page_no"), a.alias("start"), x["p"].alias("text")))).alias("out"))

    pages = F.when(F.size("__m") == 0, whole).otherwise(F.aggregate(each, start, step)["out"])
    rows = out.select("doc_id", F.explode_outer(pages).alias("p"))
    return rows.select("doc_id", "p.page_no", "p.start", (F.col("p.start") + F.length("p.text")).cast("int").alias("end"), "p.text").where("text is not null")


_SEPARATOR = "\n## P"
_HEAD = r"^ágina (\d+)[ \t]*\n?"


def read_pages(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """SRC1, SRC3: the pages of text files of any size: doc_id, name, page_no, start, end, text, as ``split_pages`` cuts them.

    The reader cuts a file at the begin of page markers, so one file is many partitions and no task holds more than its
    range of bytes and the page that it ends in. Each page is decoded by itself (``decode_text``). Places are put
    together from the lengths of ranges, a few numbers a file; lines that only look like a marker go back to their page.
    """
    raw = spark.read.option("lineSep", _SEPARATOR).option("pathGlobFilter", glob).text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    # The first piece of a file has no separator before it, and may begin with a marker of its own.
    text = decode_text(F.col("value").cast("binary"))
    rows = rows.select("file", "block", "i", text.alias("t"))
    local = Window.partitionBy("file", "block").orderBy("i")
    rows = rows.withColumns({"n": F.length("t") + len(_SEPARATOR), "first": (F.col("block") == 0) & (F.row_number().over(local) == 1)})
    marker = F.when(F.col("first"), F.col("t").rlike(r"^## P" + _HEAD[1:])).otherwise(F.col("t").rlike(_HEAD))
    rows = rows.withColumn("marker", marker)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "page": F.sum(F.col("marker").cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = rows.groupBy("file", "block").agg(F.sum("n").alias("bn"), F.sum(F.col("marker").cast("int")).alias("bp"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("b_at"), F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("b_page"), F.sum("bp").over(whole).alias("all"))
    placed = rows.join(blocks, ["file", "block"])
    placed = placed.select("file", "all", (F.col("page") + F.col("b_page")).alias("page"), (F.col("at") + F.col("b_at")).alias("at"), "first", "marker", "t")
    # What stands before the first marker is no page, unless there is no marker at all.
    piece = F.struct("at", "t", "first")
    pages = placed.where("page > 0 or all = 0").groupBy("file", "all", "page").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    joined = F.array_join(F.transform("p", lambda p: p["t"]), _SEPARATOR)
    start = F.col("p")[0]["at"]
    head = F.when(F.col("all") == 0, F.lit("")).otherwise(F.regexp_extract("t", r"^(?:## P)?" + _HEAD[1:], 0))
    # The line break before a marker belongs to the page that it ends.
    ended = F.when((F.col("page") < F.col("all")) & (F.col("all") > 0), F.concat(joined, F.lit("\n"))).otherwise(joined)
    out = pages.select("file", "all", start.alias("at"), ended.alias("t")).withColumn("head", head)
    number = F.when(F.col("all") == 0, F.lit(1)).otherwise(F.regexp_extract("head", r"(\d+)", 1).try_cast("int"))
    begin = (F.col("at") + F.length("head")).cast("int")
    body = F.substr("t", F.length("head") + 1)
    return out.select(F.xxhash64("file").alias("doc_id"), F.element_at(F.split("file", "/"), -1).alias("name"), number.alias("page_no"), begin.alias("start"), (begin + F.length(body)).cast("int").alias("end"), body.alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """SRC4: doc_id and one text with a marker before each page, in page order."""
    ordered = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return ordered.select("doc_id", F.array_join(F.transform("p", lambda p: F.concat(F.lit("## Página "), p["page_no"].cast("string"), F.lit("\n"), F.coalesce(p["text"], F.lit("")))), "\n").alias("text"))


def first_pages(docs: DataFrame, n: int) -> DataFrame:
    """SRC6: documents up to the end of page n; offsets stay."""
    end = split_pages(docs).where(F.col("page_no") <= n).groupBy("doc_id").agg(F.max("end").alias("__e"))
    return docs.join(end, "doc_id", "left").withColumn("text", F.when(F.col("__e").isNull(), "").otherwise(F.substr("text", F.lit(1), F.col("__e")))).drop("__e")


def bounding_box(polygon: Column) -> Column:
    """SRC8: (x1, y1, x2, y2) of an array of points (x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def reading_order(words: DataFrame, min_conf: float = 0.5, page: str = "page_id") -> DataFrame:
    """SRC8: words (page, text, conf, x1, y1) of enough confidence with their place: from top to bottom, then left to right."""
    order = Window.partitionBy(page).orderBy("y1", "x1", "text")
    return words.where(F.col("conf") >= min_conf).withColumn("place", F.row_number().over(order))


def regroup_words(lines: DataFrame, fragments: DataFrame) -> DataFrame:
    """SRC7: fragments (line_id, i, text, conf, x1, y1, x2, y2) put together to the words of their line (line_id, text).

    Fragments belong to the word in whose characters they end; boxes are united, the weakest confidence counts. Lines
    whose fragments do not add up to their words come back whole.
    """
    before = Window.partitionBy("line_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frag = fragments.withColumn("f", F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).over(before))
    words = lines.select("line_id", F.col("text").alias("line"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w", "word"))
    words = words.withColumn("f", F.sum(F.length("word")).over(Window.partitionBy("line_id").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = words.withColumn("a", F.col("f") - F.length("word"))
    box = [F.min("conf").alias("conf"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    sums = frag.groupBy("line_id").agg(F.max("f").alias("nf"), *box).join(words.groupBy("line_id").agg(F.max("f").alias("nw"), F.first("line").alias("text")), "line_id")
    fits = frag.alias("g").join(words.alias("v"), (F.col("g.line_id") == F.col("v.line_id")) & (F.col("g.f") > F.col("v.a")) & (F.col("g.f") <= F.col("v.f")))
    good = fits.join(sums.where("nf = nw").select(F.col("line_id").alias("__l")), F.col("g.line_id") == F.col("__l"), "left_semi")
    cut = lambda c: F.col(f"g.{c}")
    one = good.groupBy(F.col("v.line_id").alias("line_id"), F.col("v.w").alias("w"), F.col("v.word").alias("text")).agg(
        F.min(cut("conf")).alias("conf"), F.min(cut("x1")).alias("x1"), F.min(cut("y1")).alias("y1"), F.max(cut("x2")).alias("x2"), F.max(cut("y2")).alias("y2")
    )
    rest = sums.where("nf <> nw").select("line_id", F.lit(0).alias("w"), "text", "conf", "x1", "y1", "x2", "y2")
    return one.unionByName(rest)


def ocr_coverage(pages: DataFrame, served: DataFrame, least: int = 200) -> DataFrame:
    """SRC9: doc_id, needed, served, missing, any_ocr: pages whose own text is too short (never in office files) against distinct recognised pages.

    ``pages`` has doc_id, page_no, text, kind; ``served`` has doc_id, page_hash, and a null hash where it is unknown how
    many were served: then served and missing are null.
    """
    needs = (F.col("kind") == "image") | (~F.col("kind").isin("docx", "xlsx", "pptx") & (F.length(F.trim(F.coalesce("text", F.lit("")))) < least))
    needed = pages.groupBy("doc_id").agg(F.count_if(needs).alias("needed"))
    got = served.groupBy("doc_id").agg(F.count_distinct("page_hash").alias("n"), F.count_if(F.col("page_hash").isNull()).alias("unknown"))
    rows = needed.join(got, "doc_id", "left")
    n = F.when(F.coalesce("unknown", F.lit(0)) == 0, F.coalesce("n", F.lit(0)))
    return rows.select("doc_id", "needed", n.alias("served"), F.when(n.isNotNull(), F.greatest(F.col("needed") - n, F.lit(0))).alias("missing"), (F.coalesce("n", F.lit(0)) > 0).alias("any_ocr"))
