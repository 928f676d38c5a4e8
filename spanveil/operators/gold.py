"""A ground truth that is independent of the recognisers: generous candidates, confirmed by evidence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, let, norm, one_of, sha_of, unmarked, value_key
from ..functions.validators import cnj_valid, cnpj_valid, cpf_valid
from ..tables import merged_in
from . import dictionary
from .names import PARTICLES
from .patterns import _matches, words_array

# Candidate patterns: (type, name, before, value, after); without a value the whole match counts.
_STREETS = (
    r"Rua|R\.|Avenida|Av\.|Av|Travessa|Trav\.|Praça|Praca|Rodovia|Rod\.|Estrada|Sítio|Sitio|Distrito|Localidade|Conjunto|Cj\.|Alameda|Al\.|Largo|"
    r"Beco|Vila|Loteamento|Fazenda|Assentamento|Quadra"
)
_LIVES = r"residente|domiciliad[oa]|resid[ei]|endereç[oa]|endereco|moradora?\s+(?:na|no|em)|com\s+endereço"
CANDIDATES = (
    ("CPF", "cpf_formatado", "", r"\d{3}\.\d{3}\.\d{3}-\d{2}", ""),
    ("CPF", "cpf_nu", r"(?<!\d)", r"\d{11}", r"(?!\d)"),
    ("CPF", "cpf_rotulado", r"CPF[\s.:nºo°/-]*", r"\d[\d.\s-]{9,17}\d", ""),
    ("RG", "rg_rotulado", r"(?:RG|R\.G\.|Registro\s+Geral|[Ii]dentidade)[\s.:nºo°/-]*", r"\d[\d.\sXx-]{4,16}[\dXx]", ""),
    ("RG", "rg_com_orgao", "", r"\d[\d.\sXx-]{5,16}", r"\s*-?\s*(?:SSP|SSPDS|DETRAN|PC|IFP|SDS)[A-Z/\s-]{0,6}"),
    ("TELEFONE", "tel_parenteses", "", r"\(\d{2}\)\s*\d{4,5}[\s-]?\d{4}", ""),
    ("TELEFONE", "tel_solto", r"(?<!\d)", r"\d{2}\s?9?\d{4}[\s-]\d{4}", r"(?!\d)"),
    ("TELEFONE", "tel_internacional", "", r"\+55\s?\(?\d{2}\)?\s?9?\d{4}[\s-]?\d{4}", ""),
    ("CEP", "cep", r"(?<!\d)", r"\d{2}\.?\d{3}-\d{3}", r"(?!\d)"),
    ("CEP", "cep_rotulado", r"CEP[\s.:nºo°-]*", r"\d{2}\.?\d{3}[\s-]*\d{3}", ""),
    ("EMAIL", "email", "", r"[A-Za-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}", r"(?![a-z])"),
    ("CNPJ", "cnpj_formatado", "", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", ""),
    ("CNPJ", "cnpj_nu", r"(?<!\d)", r"\d{14}", r"(?!\d)"),
    ("CNJ", "cnj_formatado", "", r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", ""),
    ("CNJ", "cnj_nu", r"(?<!\d)", r"\d{20}", r"(?!\d)"),
    ("OAB", "oab", r"\bOAB\b[\s.:/nºo°-]*(?:[A-Z]{2})?[\s.:/nºo°-]*", r"\d[\d.]{2,7}", ""),
    ("OAB", "oab_invertido", "", r"\d[\d.]{2,7}\s*/\s*[A-Z]{2}\b", r"(?=[^\w]*OAB|\s*OAB)"),
    ("TITULO_ELEITOR", "titulo", "", r"[Tt][íi]tulo\s+(?:de\s+)?[Ee]leitor[\s.:nºo°-]*\d[\d.\s-]{9,14}", ""),
    ("CNH", "cnh", "", r"\bCNH\b[\s.:nºo°-]*\d[\d.\s-]{8,14}", ""),
    ("PIS", "pis", "", r"\b(?:PIS|PASEP|NIT)\b[\s.:nºo°/-]*\d[\d.\s-]{9,14}", ""),
    ("ENDERECO", "logradouro", "", rf"\b(?:{_STREETS})\s+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][^\n,;]{{2,60}}(?:,\s*(?:n[ºo°.]?\s*)?\d{{1,5}}|,\s*s/?n)?", ""),
    ("ENDERECO", "ancora", "", rf"\b(?:{_LIVES})\b[^\n]{{0,120}}", ""),
    ("DATA", "data_numerica", r"(?<!\d)", r"\d{2}/\d{2}/\d{4}", r"(?!\d)"),
)
DEFAULT_TYPES = ("CPF", "RG", "TELEFONE", "CEP", "EMAIL", "CNJ", "OAB", "CNPJ")
_FOUND = "array<struct<start:int,end:int,type:string,text:string,pattern:string>>"

# Labels of persons, suffixes that are no name, and phrases that are none.
_LABELS = (
    r"Acusad[oa]|Denunciad[oa]|Indiciad[oa]|Investigad[oa]|R[ée]u|R[ée]|V[íi]tima|V[ÍI]TIMA|Ofendid[oa]|Testemunha|Declarante|Depoente|Requerente|"
    r"Requerid[oa]|Autor[a]?|Exequente|Executad[oa]|Advogad[oa]|Defensor[a]?|Querelante|Querelad[oa]"
)
_LABELLED = rf"(?U)\b(?:{_LABELS})\s*(?:\([as]\))?\s*:\s*([A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-Za-zÁ-Úá-úÀ-ÿÇç]+(?:\s+(?:d[aeo]s?|D[AEO]S?|e|E)?\s*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-Za-zÁ-Úá-úÀ-ÿÇç]+){{1,5}})"
_SIGNED = r"(?iuU)assinado\s+digitalmente\s+por\s+([^.,\n]{5,70})"
_SUFFIX = r"(?iuU)\s+(?:e\s+outr[oa]s?|e\s+outr[oa]|P$|Não\s+[Ii]nformado.*|e\s+(?:tjce|tribunal|minist[ée]rio|justi[çc]a|[a-z0-9.-]+\.(?:br|com)).*)$"
_NOBODY = ("nao informado", "nao identificado", "a apurar", "ignorado", "menor", "sem dados", "identidade preservada", "sigiloso")
_BODY = r"(?iuU)tribunal|minist[ée]rio|justi[çc]a|defensoria|procuradoria|\.jus\.br|\.gov\.br|\.mp\.br|prefeitura|secretaria|delegacia|estado\s+do|munic[íi]pio|poder\s+judici[áa]rio|banco|caixa"
_ANCHORS = {
    "CPF": r"(?iuU)\bCPF\b|\bC\.?P\.?F\b|cadastro de pessoa|inscrit[oa] no CPF|\bCIC\b",
    "RG": r"(?iuU)\bRG\b|\bR\.?G\.?\b|registro geral|identidade|\bSSP|\bDETRAN\b",
    "CEP": r"(?iuU)\bCEP\b",
    "CNPJ": r"(?iuU)\bCNPJ\b|inscrit[oa] no CNPJ",
}


def _candidate_spans(text: Column, kind: str, name: str, before: str, value: str, after: str) -> Column:
    whole = f"(?U)(?:{before})(?:{value})(?:{after})"
    inner = f"(?Us)^((?:{before}))({value})(?:{after})$"

    def span(x: Column) -> Column:
        m = x["m"]
        core = F.when(F.regexp_extract(m, inner, 2) != "", F.regexp_extract(m, inner, 2)).otherwise(m)
        lead = F.when(F.regexp_extract(m, inner, 2) != "", F.length(F.regexp_extract(m, inner, 1))).otherwise(0)
        bare = F.regexp_replace(core, r"[ .,;:\-\n\t]+$", "")
        left = F.length(F.regexp_extract(bare, r"^[ .,;:\-\n\t]+", 0))
        start = x["a"] + lead + left
        return F.struct(start.cast("int").alias("start"), (start + F.length(bare) - left).cast("int").alias("end"), F.lit(kind).alias("type"), F.substr(text, (start + 1).cast("int"), F.length(bare) - left).alias("text"), F.lit(name).alias("pattern"))

    return F.filter(F.transform(_matches(unmarked(text), whole), span), lambda s: s["end"] > s["start"])


def candidates(docs: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """doc_id, start, end, type, text, pattern of every candidate, whatever speaks for it."""
    wanted = set(types or {c[0] for c in CANDIDATES})
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[_candidate_spans(text, *c) for c in CANDIDATES if c[0] in wanted]).cast(_FOUND)
    return docs.select("doc_id", F.explode_outer(found).alias("c")).select("doc_id", "c.*").where("start is not null")


def group_candidates(found: DataFrame) -> DataFrame:
    """A-3: candidates by type and value."""
    return found.groupBy("type", value_key(F.col("text")).alias("value")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def has_anchor(text: Column, kind: str, start: Column, end: Column) -> Column:
    """P10: an anchor of the type in the 45 characters before or the 25 behind."""
    left = F.substr(text, F.greatest(start - 44, F.lit(1)), F.least(start, F.lit(45)))
    return F.concat(left, F.lit(" "), F.substr(text, end + 1, F.lit(25))).rlike(_ANCHORS[kind])


# What has to stand near a postal code, what must not, and what a telephone number must not touch or end with.
_NEAR_CEP, _NOT_NEAR_CEP = r"(?iuU)\bCEP\b|rua|avenida|\bav\.|bairro|centro|s[íi]tio|distrito|residente|domiciliad", r"(?iu)fone|tel|cel|whats|contato"
_LETTER_BEFORE, _YEAR_BEHIND = "[A-Za-z]$", r"(?U)\b(?:19|20)\d{2}$"


def _evidence(text: Column, value: Column, pattern: Column, start: Column, end: Column) -> dict[str, tuple[Column, ...]]:
    """What each type takes as evidence: any one entry is enough. Types without an entry need none."""
    around = F.substr(text, F.greatest(start - 59, F.lit(1)), F.least(start, F.lit(60)) + (end - start) + 40)
    before = F.substr(text, F.greatest(start - 2, F.lit(1)), F.least(start, F.lit(3)))
    named = lambda p: pattern == p
    anchored = lambda kind: has_anchor(text, kind, start, end)
    return {
        "CEP": (named("cep_rotulado"), around.rlike(_NEAR_CEP) & ~around.rlike(_NOT_NEAR_CEP)),
        "CNJ": (named("cnj_formatado"), cnj_valid(value)),
        "CNPJ": (anchored("CNPJ"), cnpj_valid(value)),
        "CPF": (named("cpf_formatado"), anchored("CPF"), cpf_valid(value)),
        "RG": (F.length(digits(value)).between(5, 14),),
        "TELEFONE": (~before.rlike(_LETTER_BEFORE) & ~value.rlike(_YEAR_BEHIND),),
    }


def confirm(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with enough evidence; doubtful ones are left out."""
    rows = found.join(merged_in(docs.select("doc_id", F.col("text").alias("__t"))), "doc_id")
    table = _evidence(F.col("__t"), F.col("text"), F.col("pattern"), F.col("start"), F.col("end"))
    enough = ~F.col("type").isin(*table)
    for kind, ways in table.items():
        for way in ways:
            enough = enough | ((F.col("type") == kind) & way)
    return rows.where(enough).drop("__t")


def first_of_overlapping(found: DataFrame) -> DataFrame:
    """Of candidates of one type that overlap in a document the first by (start, longest) stays."""
    item = F.struct("start", (-F.col("end")).alias("o"), "end", "text", "pattern")
    rows = found.groupBy("doc_id", "type").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<start:int,o:int,end:int,text:string,pattern:string>>"
    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select("doc_id", "type", F.explode_outer(kept).alias("k")).select("doc_id", "type", "k.start", "k.end", "k.text", "k.pattern")


def significant_parts(name: Column) -> Column:
    return F.filter(F.split(F.trim(name), r"(?U)\s+"), lambda p: ~norm(p).isin(*PARTICLES) & p.rlike("^[A-Za-zÁ-Úá-úÀ-ÿÇç]{2,}$"))


def plausible_name(name: Column) -> Column:
    """At least two parts of letters, two of them with a vowel, and no phrase for nobody."""
    parts = significant_parts(name)
    vowels = F.size(F.filter(parts, lambda p: p.rlike("(?iu)[aeiouáéíóúâêôãõà]")))
    return ~norm(name).isin(*_NOBODY) & (F.size(parts) >= 2) & (vowels >= 2)


# Words of proceedings, roles, bodies and forms, and words beside a signature; a name of the truth ends at the first of them.
STOP_WORDS = (
    "certifico certidao certidoes vistos designo conforme denuncia mandado oficio cota ministerial pedido diligencias trata considerando inquerito termo "
    "audiencia ata decisao sentenca despacho peticao laudo exame auto autos prisao flagrante boletim ocorrencia envio publicacao intimacao citacao acordo "
    "alegacoes memoriais recibo guia carta precatoria aditamento cumprimento requerido requerida requerente acusado acusada vitima testemunha declarante "
    "denunciado denunciada indiciado indiciada advogado advogada reu re autor autora oficial justica juiz juiza promotor promotora delegado delegada "
    "escrivao escriva secretaria diretora vara comarca estado poder judiciario tribunal ministerio publico defensoria defensor policia policial militar "
    "civil delegacia forum cartorio central nome endereco enderecos data hora local processo numero classe assunto cpf rg filiacao naturalidade profissao "
    "observacoes sem nao informado mm exmo exma meritissimo meritissima em as no na pelo pela por servidor servidora magistrado magistrada analista "
    "tecnico assessor assessora chefe coordenador coordenadora"
).split()


def _before_stop_word(name: Column) -> Column:
    tokens = F.transform(F.split(name, " "), lambda t: F.struct(t.alias("t"), one_of(norm(t), STOP_WORDS).alias("stop")))

    def head(ts: Column) -> Column:
        stop = F.array_position(F.transform(ts, lambda x: x["stop"]), True).cast("int")
        return F.array_join(F.transform(F.when(stop > 0, F.slice(ts, F.lit(1), stop - 1)).otherwise(ts), lambda x: x["t"]), " ")

    return let(tokens, head)


def _clean(name: Column) -> Column:
    """A name without suffix, cut before the first stop word, without particles at its end."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), _SUFFIX, ""), r"(?U)\s+", " "))
    links = "|".join(PARTICLES)
    return F.regexp_replace(_before_stop_word(bare), rf"(?iu)(?:\s+(?:{links}))+$", "")


def gold_names(docs: DataFrame) -> DataFrame:
    """(doc_id, name): names behind labels and in signatures that are no institution."""
    labelled = F.regexp_extract_all("text", F.lit(_LABELLED), F.lit(1))
    signed = F.filter(F.regexp_extract_all("text", F.lit(_SIGNED), F.lit(1)), lambda n: ~n.rlike(_BODY))
    rows = docs.select("doc_id", F.explode_outer(F.concat(labelled, signed)).alias("raw")).select("doc_id", _clean(F.col("raw")).alias("name"))
    return rows.where(F.col("name").isNotNull() & plausible_name(F.col("name"))).distinct()


def name_variants(names: DataFrame) -> DataFrame:
    """(doc_id, name, variant): the name, its tails and its heads with two significant parts."""
    tokens = F.split("name", " ")
    n = F.size(tokens)
    range_ = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    tails = F.transform(range_(F.lit(2), n - 1), lambda i: F.slice(tokens, i, n))
    heads = F.transform(range_(F.lit(2), n - 1), lambda i: F.slice(tokens, F.lit(1), i))
    good = lambda b: ~norm(F.element_at(b, 1)).isin(*PARTICLES) & ~norm(F.element_at(b, -1)).isin(*PARTICLES) & (F.size(significant_parts(F.array_join(b, " "))) >= 2)
    every = F.array_distinct(F.concat(F.array("name"), F.transform(F.filter(F.concat(tails, heads), good), lambda b: F.array_join(b, " "))))
    return names.select("doc_id", "name", F.explode(every).alias("variant"))


def name_occurrences(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Where a document's names occur whatever case, accents and white space; longest first, without overlaps.

    The search is by joins on tokens (``operators.dictionary``) with the document as the key; doc_id is unique.
    """
    terms = name_variants(names).select("doc_id", value_key(F.col("variant")).alias("value")).distinct().withColumns({"length": F.length("value"), "rank": F.col("value")})
    texts = docs.select("doc_id", F.lit(0).alias("text_id"), "text")
    found = dictionary.resolved(dictionary.candidates(texts, terms, "doc_id", apart=True), "doc_id", "leftmost", "length")
    rows = dictionary.with_offsets(found, texts, "doc_id")
    return rows.select("doc_id", "start", "end", F.lit("PERSON").alias("type"), F.col("found").alias("text"))


def build_gold(docs: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """The whole truth: doc_id, type, start, end, sha256 and key of the value, source. Values themselves are not kept (SNK3)."""
    people = name_occurrences(docs, gold_names(docs)).withColumn("source", F.lit("name"))
    found = first_of_overlapping(confirm(candidates(docs, types or DEFAULT_TYPES), docs)).withColumn("source", F.concat(F.lit("regex:"), "pattern"))
    both = people.unionByName(found.drop("pattern"))
    digest = sha_of(F.col("text"))
    return both.select("doc_id", "type", "start", "end", digest.alias("sha256"), F.concat("type", F.lit(":"), F.substring(digest, 1, 12)).alias("key"), "source")
