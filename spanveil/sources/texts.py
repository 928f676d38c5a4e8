"""Reading and writing of texts, lexicons and runs (SRC1, SRC2, SRC10, SRC11, SNK2, SNK5, SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm

# The code points that the bytes 0x80 to 0x9F stand for in the Western Windows code page, in order.
_WINDOWS = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def decode_text(content) -> "F.Column":
    """SRC1: bytes as UTF-8, or as the Western Windows code page where they are no UTF-8."""
    latin = F.decode(content, "ISO-8859-1")
    pairs = [(chr(0x80 + i), c) for i, c in enumerate(_WINDOWS) if c != " "]
    western = F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)


def read_texts(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """SRC1, SRC2: one row per file: doc_id (hash of the path), name, text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), decode_text(F.col("content")).alias("text"))


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: a JSON object of type to list of terms as (type, term), normalised."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("type", "terms")).select("type", F.explode("terms").alias("term")).select("type", norm(F.col("term")).alias("term")).where("term <> ''").distinct()


def load_context(spark: SparkSession, path: str, most: int = 5000) -> dict[str, tuple[str, ...]]:
    """SRC10: a JSON object of type to list of context words, as ``detect(context=...)`` takes it."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("type", "words"))
    rows = raw.select("type", F.explode("words").alias("word")).where(F.trim("word") != "").distinct().orderBy("type", "word").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} context words")
    return {t: tuple(r["word"] for r in rows if r["type"] == t) for t in sorted({r["type"] for r in rows})}


def replace_terms(terms: DataFrame, path: str) -> None:
    """SNK5: write the whole deny list as a new version beside the old one, and then swap it in.

    ``path`` is a folder of versions; the swap is the rename of a file that names the current one, so a reader has the
    old list or the new one, never a part.
    """
    import uuid

    spark, version = terms.sparkSession, uuid.uuid4().hex
    terms.select("type", "term").distinct().write.parquet(f"{path}/{version}")
    places = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f".current-{version}", "current")]
    fs = places[0].getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(places[0], True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(places[0].toUri() if places[0].isAbsolute() and places[0].toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fs.makeQualified(places[0]), fs.makeQualified(places[1]), options)


def current_terms(spark: SparkSession, path: str) -> DataFrame:
    """The deny list that ``replace_terms`` has put in place last."""
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def as_lists(terms: DataFrame, most: int = 5000) -> dict[str, list[str]]:
    """Terms as a plan-time dictionary for row-local matching; larger lists are an error: join them instead (deny_exact)."""
    rows = terms.orderBy("type", "term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["type"], []).append(r["term"])
    return out


def deny_exact(entities: DataFrame, deny: DataFrame) -> DataFrame:
    """Entities (type, text) that are no deny term of their type or of ``*``, for lists of any size."""
    n = norm(F.col("text"))
    out = entities.withColumn("__n", n)
    own = deny.select("type", F.col("term").alias("__n"))
    everywhere = deny.where("type = '*'").select(F.col("term").alias("__n"))
    return out.join(own, ["type", "__n"], "left_anti").join(everywhere, "__n", "left_anti").drop("__n")


def add_deny_term(deny: DataFrame, kind: str, term: str) -> DataFrame:
    """SNK5: the list with a term, unless it is there in other case or accents."""
    new = deny.sparkSession.range(1).select(F.lit(kind).alias("type"), norm(F.lit(term)).alias("term"))
    return deny.unionByName(new.join(deny, ["type", "term"], "left_anti"))


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: run files {doc: {sha256, chars, segundos, tipos: {type: {...}}}} as one row per document and type."""
    kind = "map<string,struct<sha256:string,chars:long,segundos:double,modo_nlp:string,deteccoes:long,tipos:map<string,map<string,double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("doc", "r"))
    return rows.select("doc", "r.sha256", "r.chars", "r.segundos", "r.modo_nlp", "r.deteccoes", F.explode_outer("r.tipos").alias("type", "metrics"))


def write_masked(df: DataFrame, path: str, fmt: str = "text", source: str | None = None) -> None:
    """SNK2, SNK6: write results as text, json or parquet to a new place; never over the input or anything else."""
    if source is not None and path.rstrip("/") == source.rstrip("/"):
        raise ValueError("the output must not replace the input")
    if fmt not in ("text", "json", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    (df.select("anonymized_text") if fmt == "text" else df).write.mode("errorifexists").format(fmt).save(path)
