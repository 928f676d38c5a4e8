"""Pseudonyms across documents and conversations, closing, re-hydration and the egress guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LABELS, estimate_tokens, label_of, let, value_key, weight
from ..tables import merged_in, written
from . import dictionary
from .masking import masks_of

LABEL = r"\[(\p{Lu}+(?:_\p{Lu}+)*)_(\d+)\]"
#: Values with fewer letters and digits are too weak to look for.
LEAST_WEIGHT = 3
_KNOWN = sorted(set(LABELS.values()))


def labels_in(text: Column) -> Column:
    """The placeholders of a text whose label is known, in order."""
    found = F.regexp_extract_all(text, F.lit(LABEL), F.lit(0))
    return F.filter(found, lambda m: F.regexp_extract(m, LABEL, 1).isin(*_KNOWN))


def check_labels(masked: DataFrame) -> DataFrame:
    """(doc_id, reason) for (doc_id, anonymized_text, entities): the placeholders have to be those that the entities give."""
    own = masks_of(F.col("entities"), "placeholder")
    rows = masked.select("doc_id", own.alias("own"), labels_in(F.col("anonymized_text")).alias("seen"))
    place = F.array_position(F.zip_with("own", "seen", lambda a, b: ~a.eqNullSafe(b)), True)
    return rows.select("doc_id", F.when(place > 0, F.concat(F.lit("placeholder "), place.cast("string"), F.lit(" does not follow from the entities"))).alias("reason"))


def session_pseudonyms(entities: DataFrame, session: str = "session_id", order: str = "ord") -> DataFrame:
    """One number per label and value in a session, by document order and then place.

    ``entities`` has the session, the document's place in it, type, text and start. Returns the session, label,
    norm_value, n and first_value (the first spelling). Numbers of a label are dense from 1.
    """
    keyed = entities.select(session, order, "start", "text", label_of(F.col("type")).alias("label"), value_key(F.col("text")).alias("norm_value"))
    first = keyed.groupBy(session, "label", "norm_value").agg(F.min(F.struct(order, "start", "text")).alias("first"))
    n = F.dense_rank().over(Window.partitionBy(session, "label").orderBy(F.col(f"first.{order}"), "first.start", "norm_value"))
    return first.select(session, "label", "norm_value", n.alias("n"), F.col("first.text").alias("first_value"))


def with_session_labels(docs: DataFrame, entities: DataFrame, pseudonyms: DataFrame, session: str = "session_id") -> DataFrame:
    """Translate the placeholders of (doc_id, session, anonymized_text) from document to session numbers in one pass."""
    local = entities.select("doc_id", session, "start", label_of(F.col("type")).alias("label"), value_key(F.col("text")).alias("norm_value"))
    local = local.groupBy("doc_id", session, "label", "norm_value").agg(F.min("start").alias("start"))
    local = local.withColumn("m", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("start")))
    tag = lambda c: F.concat(F.lit("["), "label", F.lit("_"), F.col(c).cast("string"), F.lit("]"))
    pairs = local.join(merged_in(pseudonyms), [session, "label", "norm_value"]).select("doc_id", F.struct(tag("m").alias("k"), tag("n").alias("v")).alias("p"))
    table = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("p")).alias("__map"))
    out = docs.join(merged_in(table), "doc_id", "left")
    text = F.col("anonymized_text")
    found, gaps = F.regexp_extract_all(text, F.lit(LABEL), F.lit(0)), F.split(text, LABEL, -1)
    there = F.coalesce("__map", F.create_map().cast("map<string,string>"))
    moved = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.element_at(there, m), m, F.lit(""))))
    return out.withColumn("session_text", F.array_join(moved, "")).drop("__map")


def close_residuals(texts: DataFrame, pseudonyms: DataFrame, session: str = "session_id", prefer: str = "longest", few: bool = False) -> DataFrame:
    """Replace every known value of a session that is left in its texts, whatever its case, accents and white space.

    Longer values come first, wherever they stand (``prefer="leftmost"``: the first place decides, then the longer
    value); existing placeholders and parts of words stay; values below the least weight are not looked for. Adds
    closed_text, closed (map label to count) and examples (label: spelling). Equal texts of a session are searched once,
    by joins on tokens (``operators.dictionary``). A null text stays null, with empty maps.

    With ``few`` the values are written and measured when this is called; up to ``dictionary.MOST_IN_ROW`` bytes of them are
    looked up in each text by itself, and no text or token is shuffled.
    """
    strong = pseudonyms.where(weight(F.col("norm_value")) >= LEAST_WEIGHT)
    tag = F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    # A value with several labels is closed by the first of them.
    terms = strong.groupBy(session, F.col("norm_value").alias("value")).agg(F.min(F.struct("label", tag.alias("tag"))).alias("__b"))
    terms = terms.select(session, "value", F.col("__b.label").alias("label"), F.col("__b.tag").alias("tag"), F.length("value").alias("length"), F.col("value").alias("rank"))
    look = None
    if few:
        terms = written(terms, "terms")
        look = dictionary.in_row(terms.drop("length", "rank"), session)
    if look is not None:
        table, places = look
        # Length and rank follow from the value, and are not carried.
        ranked = lambda x: F.struct(x["pos"], x["n"], x["label"], x["tag"], F.length(x["value"]).alias("length"), x["value"].alias("rank"))
        own = lambda w: F.transform(places(F.col("__d"), F.col(session), F.col("text"), w, LABEL), ranked)
        made = let(dictionary.tokens(F.col("text"), LABEL), lambda w: let(F.sort_array(dictionary.resolved_in_row(own(w), prefer, "length")), lambda m: F.struct(*_closed(F.col("text"), w, m))))
        return dictionary.with_dictionary(texts, table, "__c", made).select(*texts.columns, "__c.*")
    own = texts.select(session, F.md5("text").alias("text_id"), "text").where("text is not null").dropDuplicates([session, "text_id"])
    found = dictionary.resolved(dictionary.candidates(own, terms, session, protected=LABEL), session, prefer, "length")
    by_text = found.groupBy(session, "text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "label", "tag"))).alias("__m"))
    out = texts.withColumn("text_id", F.md5("text")).join(merged_in(by_text), [session, "text_id"], "left").drop("text_id")
    out = out.withColumn("__w", F.when(F.col("__m").isNotNull(), dictionary.tokens(F.col("text"), LABEL)))
    return out.select(*texts.columns, *_closed(F.col("text"), F.col("__w"), F.col("__m")))


def _closed(text: Column, w: Column, m: Column) -> list[Column]:
    """closed_text, closed and examples of a text with tokens ``w`` and places ``m`` (pos, n, label, tag), in order; null or none of them: as it is."""
    part = lambda a, n: F.array_join(F.slice(w, a + 1, n), "")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["pos"] + F.get(m, i - 1)["n"])
    cut = F.transform(m, lambda x, i: F.concat(part(before(i), x["pos"] - before(i)), x["tag"]))
    tail = before(F.size(m))
    closed = F.array_join(F.concat(cut, F.array(part(tail, F.size(w) - tail))), "")
    none = F.array().cast("array<string>")
    kinds = F.coalesce(F.array_distinct(F.transform(m, lambda x: x["label"])), none)
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(m, lambda x: x["label"] == k))))
    first = lambda k: F.filter(m, lambda x: x["label"] == k)[0]
    shown = F.transform(kinds, lambda k: F.concat(k, F.lit(": "), part(first(k)["pos"], first(k)["n"])))
    return [F.when(F.size(m) > 0, closed).otherwise(text).alias("closed_text"), counts.alias("closed"), shown.alias("examples")]


def prepare_turns(turns: DataFrame, spans: DataFrame, session: str = "session_id") -> DataFrame:
    """The numbers of new turns continue those of a session: pseudonyms over earlier and new entities together."""
    return session_pseudonyms(spans.join(turns.select("doc_id", session, "ord"), "doc_id"), session)


def rehydrate(texts: DataFrame, pseudonyms: DataFrame, session: str = "session_id") -> DataFrame:
    """Cut texts at placeholders: id, pos, kind (text, value, unknown), text, value. Unknown placeholders are kept."""
    gaps, found = F.split("text", LABEL, -1), F.regexp_extract_all("text", F.lit(LABEL), F.lit(0))
    both = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(F.struct(F.lit("text").alias("kind"), g.alias("text")), F.struct(F.lit("label").alias("kind"), m.alias("text")))))
    both = F.filter(both, lambda p: p["text"].isNotNull() & (p["text"] != ""))
    rows = texts.select("id", session, F.posexplode(both).alias("pos", "p")).select("id", session, "pos", "p.kind", "p.text")
    rows = rows.withColumn("label", F.regexp_extract("text", LABEL, 1)).withColumn("n", F.expr(r"try_cast(regexp_extract(text, '\\[.*_(\\d+)\\]$', 1) AS int)"))
    values = pseudonyms.select(session, "label", "n", F.col("first_value").alias("value"))
    out = rows.join(merged_in(values), [session, "label", "n"], "left")
    kind = F.when(F.col("kind") == "text", "text").when(F.col("value").isNull(), "unknown").otherwise("value")
    return out.select("id", "pos", kind.alias("kind"), "text", F.when(F.col("kind") != "text", F.col("value")).alias("value"))


def forbidden_values(entities: DataFrame, index: DataFrame, session: str = "session_id") -> DataFrame:
    """Everything that must not leave: entity values, file names, case numbers and paths; columns session, type, value."""
    parts = [entities.select(session, "type", F.col("text").alias("value"))]
    parts += [index.select(session, F.lit(t).alias("type"), F.col(c).alias("value")) for c, t in (("name", "NOME_ARQUIVO"), ("cnj", "NUMERO_PROCESSO_CNJ"), ("path", "CAMINHO")) if c in index.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null").distinct()


def guard_hits(out: DataFrame, forbidden: DataFrame, session: str = "session_id", exempt: list[str] | None = None) -> DataFrame:
    """(id, type, pos) where an outgoing text holds a forbidden value of its session; the value is never told.

    Compared whatever the case, accents and white space, not inside of words; values below the least weight are not
    looked for; exempt passages are skipped. The search is by joins on tokens (``operators.dictionary``).
    """
    text = F.col("text")
    for passage in exempt or []:
        text = F.replace(text, F.lit(passage), F.lit("\u0000" * len(passage)))
    terms = forbidden.where(weight(F.col("value")) >= LEAST_WEIGHT).select(session, "type", value_key(F.col("value")).alias("value")).distinct()
    texts = out.select(session, F.col("id").alias("text_id"), text.alias("text"))
    # A value that is forbidden as several types is looked for once.
    terms = terms.groupBy(session, "value").agg(F.collect_set("type").alias("types"))
    found = dictionary.candidates(texts, terms, session).select(session, "text_id", "pos", F.explode("types").alias("type"))
    first = found.groupBy(session, "text_id", "type").agg(F.min("pos").alias("pos"))
    placed = first.join(merged_in(texts), [session, "text_id"])
    pos = F.length(F.array_join(F.slice(dictionary.tokens(F.col("text")), F.lit(1), F.col("pos")), ""))
    return placed.select(F.col("text_id").alias("id"), "type", pos.cast("int").alias("pos"))


def egress_guard(out: DataFrame, forbidden: DataFrame, session: str = "session_id", exempt: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(allowed rows, hits of the blocked ones)."""
    hits = guard_hits(out, forbidden, session, exempt)
    return out.join(hits.select("id").distinct(), "id", "left_anti"), hits


def assemble_prompts(texts: DataFrame, turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session the documents under headings, the earlier turns, and the question (the last turn)."""
    docs = texts.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("d"))
    heads = F.transform("d", lambda d, i: F.concat(F.lit("## Documento "), (i + 1).cast("string"), F.lit("\n\n"), d["text"]))
    said = turns.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    prompt = F.concat_ws("\n\n", F.array_join(heads, "\n\n"), F.array_join(lines, "\n\n"))
    return docs.join(said, session, "full_outer").select(session, prompt.alias("prompt"), estimate_tokens(prompt).alias("tokens"))


def eligibility(content: DataFrame) -> DataFrame:
    """(doc_id, reason): only texts masked by placeholders may be used; an undeclared policy is read from the text."""
    inferred = F.coalesce("policy", F.when(F.size(labels_in(F.col("text"))) > 0, "placeholder"))
    reason = F.when(F.col("text").isNull(), "no text").when(inferred.isNull(), "unknown policy").when(inferred != "placeholder", F.concat(F.lit("masked by policy "), inferred))
    return content.select("doc_id", reason.alias("reason"))


def provenance_warnings(content: DataFrame, asked_all: int = 14) -> DataFrame:
    """(doc_id, warning): weak or unknown engine, fewer types asked than there are, or unknown types."""
    found = F.array_compact(
        F.array(
            F.when(F.col("engine").isNull(), "engine unknown"),
            F.when(F.col("engine") == "spacy", "weak engine"),
            F.when(F.col("requested").isNull(), "requested types unknown"),
            F.when(F.size("requested").between(1, asked_all - 1), "not all types were requested"),
        )
    )
    return content.select("doc_id", F.explode_outer(found).alias("warning")).where("warning is not null")


def closed_summary(closed: DataFrame, session: str = "session_id") -> DataFrame:
    """X11: closed values of a session by label, most first, as one text."""
    rows = closed.select(session, F.explode_outer("closed").alias("label", "n")).where("label is not null").groupBy(session, "label").agg(F.sum("n").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "label", "n")))
    return rows.groupBy(session).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"])), ", ").alias("summary"))


def session_costs(prompts: DataFrame, prices: DataFrame, out_tokens: int = 1500) -> DataFrame:
    """Tokens and price of each session and model: prices has model, context, price_in, price_out (a million), over, factor.

    Above ``over`` input tokens the price is multiplied by ``factor``; overflow tells that the context is too small.
    """
    priced = prompts.join(prices, "model")
    tier = F.when(F.col("tokens") > F.col("over"), F.col("factor")).otherwise(1.0)
    cost = (F.col("tokens") * F.col("price_in") + out_tokens * F.col("price_out")) / 1e6 * tier
    return priced.groupBy("session_id", "model").agg(F.sum("tokens").alias("tokens"), F.sum(cost).alias("cost"), F.bool_or(F.col("tokens") + out_tokens > F.col("context")).alias("overflow"))
