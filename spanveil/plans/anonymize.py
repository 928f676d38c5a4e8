"""Detection to masked text as one lazily composed plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import check_policy
from ..functions.text import caps_to_title, label_of, made_once, search_view, value_key
from ..operators import names
from ..operators.fuse import fuse, fuse_spans
from ..operators.intervals import cut_out, owned, windows
from ..operators.masking import apply_masks, fenced
from ..operators.patterns import REGISTRY, THRESHOLD, detect, with_external_spans
from ..operators.session import session_pseudonyms
from ..tables import written

#: A small deny list of institutional terms; load a fuller one with sources.texts.load_terms.
DENY = {"*": ("ministério público", "poder judiciário", "tribunal de justiça", "defensoria pública", "estado do ceará")}


def anonymize(
    docs: DataFrame,
    entities: Iterable[str] | None = None,
    policy: str = "placeholder",
    external: DataFrame | None = None,
    external_labels: dict[str, str] | None = None,
    deny: dict[str, Iterable[str]] | None = None,
    containment: str = "word",
    titled: bool = False,
    specs=REGISTRY,
    threshold: float = THRESHOLD,
    as_found: tuple[str, ...] = (),
    scores: bool = True,
) -> DataFrame:
    """Add entities, anonymized_text, politica_mascara and valores_distintos to (doc_id, text).

    Without ``external`` spans the whole plan is row-local: no shuffle, no Python code, usable on streams. The order is
    part of the meaning: institutions leave before names spread through the document, and again after their extension.
    Types in ``as_found`` keep the borders that their pattern has, also where two of them touch. Without ``scores`` the entities
    are the same, but their scores may lack what context words add.
    """
    check_policy(policy)
    deny = DENY if deny is None else deny
    text = F.coalesce(F.col("text"), F.lit(""))
    out = detect(docs, entities, specs, threshold, scores=scores)
    if external is not None:
        out = with_external_spans(out, external, external_labels or {})
    out = _judged(out, text, deny, containment, titled, as_found)
    out = _spread(names.with_name_pattern(out, text), text)
    out = fuse_spans(out.withColumn("spans", F.concat("spans", "__spread")), text, apart=as_found)
    # A filter on entities must not be pushed through the steps above, which would write them all into one expression.
    return apply_masks(fenced(out.drop("__view", "__rx", "__spread", "spans"), "entities"), policy)


def _judged(out: DataFrame, text, deny: dict[str, Iterable[str]], containment: str, titled: bool, as_found: tuple[str, ...] = ()) -> DataFrame:
    """Spans after extension, deny list, trimming and institutions; adds ``__view``."""
    view = search_view(text)
    out = out.withColumn("__view", caps_to_title(view) if titled else view)
    v, s = F.col("__view"), F.col("spans")
    terms = tuple(sorted((kind, tuple(sorted(own))) for kind, own in deny.items()))
    out = out.withColumn("spans", made_once("extended", lambda: names.extend_persons(v, s)))
    out = out.withColumn("spans", made_once(("deny", terms, containment), lambda: names.apply_deny(v, s, deny, containment)))
    out = out.withColumn("spans", made_once(("trimmed", as_found), lambda: names.trim_spans(v, s, as_found)))
    return out.withColumn("spans", made_once("clipped", lambda: names.clip_institutions(v, s)))


def _spread(out: DataFrame, text) -> DataFrame:
    """Add ``__spread``, the spans of the names in ``__rx`` wherever they stand."""
    v, s = F.col("__view"), F.col("__spread")
    out = names.with_pattern_spans(out, text, "PERSON", 0.6)
    out = out.withColumn("__spread", made_once("spread extended", lambda: names.extend_persons(v, s)))
    out = out.withColumn("__spread", made_once("spread trimmed", lambda: names.trim_spans(v, s)))
    return out.withColumn("__spread", made_once("spread clipped", lambda: names.clip_institutions(v, s)))


def entities_by_windows(
    docs: DataFrame,
    entities: Iterable[str] | None = None,
    deny: dict[str, Iterable[str]] | None = None,
    containment: str = "word",
    titled: bool = False,
    specs=REGISTRY,
    threshold: float = THRESHOLD,
    as_found: tuple[str, ...] = (),
    size: int = 8000,
    overlap: int = 2400,
) -> DataFrame:
    """D1 to D11 for very long texts: one row per entity (doc_id, type, text, start, end, score), as ``anonymize`` finds them.

    A text is searched in overlapping windows, which are dealt over tasks; a span belongs to the window in whose core it
    begins, so none counts twice, and half an overlap on both sides has to hold what a pattern, an extension or a context
    looks at. The names of a document are put together over its windows, and then looked for in each of them.
    doc_id is unique.
    """
    deny = DENY if deny is None else deny
    text = F.col("text")
    cut = windows(docs.select("doc_id", "text"), size, overlap).repartition("doc_id", "win")
    # Windows and their spans are read three times.
    cut = written(_judged(detect(cut, entities, specs, threshold), text, deny, containment, titled, as_found), "windows")
    cut = cut.withColumn("__own", owned(F.col("spans")))
    local = F.filter("spans", lambda s: (s["start"] + F.col("start") >= F.col("core_start")) & (s["start"] + F.col("start") < F.col("core_end")))
    people = cut.select("doc_id", F.explode(names.certain_names(text, local)).alias("name")).groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("__sure"))
    rx = names.pattern_of(people, "__sure").select("doc_id", "__rx").where("__rx is not null")
    found = _spread(cut.join(rx, "doc_id"), text).select("doc_id", F.explode(owned(F.col("__spread"))).alias("s"))
    rows = cut.select("doc_id", F.explode("__own").alias("s")).unionByName(found).select("doc_id", "s.start", "s.end", "s.type", "s.score")
    fused = written(fuse(rows, docs, apart=as_found), "fused")
    return cut_out(fused, docs).select("doc_id", "type", F.col("value").alias("text"), "start", "end", "score")


def anonymize_long(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, anonymized_text, n_entities) of very long texts, masked by placeholders: as ``anonymize``, with a text's parts over many tasks.

    Numbers are those of first appearance; a masked text is put together from the entities and what lies between them.
    """
    found = written(entities_by_windows(docs, **options), "entities")
    keyed = found.withColumns({"label": label_of(F.col("type")), "norm_value": value_key(F.col("text")), "__o": F.lit(0)})
    numbers = session_pseudonyms(found.withColumn("__o", F.lit(0)), "doc_id", "__o").select("doc_id", "label", "norm_value", "n")
    tag = F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    tags = keyed.join(numbers, ["doc_id", "label", "norm_value"]).select("doc_id", "start", tag.alias("value"))
    size = docs.where("text is not null").select("doc_id", F.length("text").alias("__n"))
    borders = found.select("doc_id", "start", "end").unionByName(size.select("doc_id", F.col("__n").alias("start"), F.col("__n").alias("end")))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    gaps = borders.select("doc_id", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("start"), F.col("start").alias("end")).where("start < end")
    pieces = cut_out(gaps, docs).select("doc_id", "start", "value").unionByName(tags)
    joined = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "").alias("__t"))
    counts = found.groupBy("doc_id").agg(F.count("*").alias("__c"))
    out = docs.select("doc_id", "text").join(joined, "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("__t", F.lit(""))).alias("anonymized_text"), F.coalesce("__c", F.lit(0)).alias("n_entities"))


def anonymize_safe(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(results, failures with a reason): a bad document never sinks the others."""
    # Empty is a text of spaces of any kind (no-break, ideographic and others), as SQL's trim has it; line breaks are a text.
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull(), "no text").when(~F.col("text").rlike(r"[^\p{Zs}]"), "empty text")
    judged = docs.withColumn("reason", reason)
    return anonymize(judged.where("reason is null").drop("reason"), **options), judged.where("reason is not null")


def entity_rows(anonymized: DataFrame) -> DataFrame:
    """One row per entity: doc_id, type, text, start, end, score."""
    rows = anonymized.select("doc_id", F.explode_outer("entities").alias("e"))
    return rows.select("doc_id", "e.type", "e.text", "e.start", "e.end", "e.score").where("type is not null")


def batch_summary(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """A-17: how many documents were processed and how many failed, by reason."""
    rows = ok.select(F.lit("processed").alias("outcome")).unionByName(failed.select(F.concat(F.lit("failed: "), "reason").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
