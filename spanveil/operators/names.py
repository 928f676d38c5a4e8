"""People's names: extension, institutions, propagation in a document (D3 to D10), all row-local Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, marked_matches, norm, one_of, plain_norm, quoted, trie_pattern, unmarked
from .patterns import CERTAIN, SPANS, _matches, words_array

# Letters and particles of names, and words that end an extension.
_UP = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
_LOW = "a-záàâãéèêíïóôõöúçñ"
_LINKS = "DE|DA|DO|DOS|DAS|E|DI|DEL|VON|De|Da|Do|Dos|Das|Di|Del|Von|de|da|do|dos|das|e|di|del|von"
_ENDS = (
    "audiencia audiência processo pena prisao prisão cumprimento medida direito acordo termo tutela instancia instância origem defesa acusacao "
    "acusação sentenca sentença"
).split()
_STOPPED = rf"(?!(?i:{'|'.join(_ENDS)})(?![{_UP}{_LOW}]))"
_RIGHT = rf"(?U)^(?:\s+(?:{_LINKS})\s+{_STOPPED}[{_UP}][{_UP}{_LOW}]+)+"
_LEFT = rf"(?U)(?:[{_UP}][{_UP}{_LOW}]+\s+(?:{_LINKS})\s+)+$"
#: Whether the 40 characters before a name can end with what ``_LEFT`` ends with.
_LINKED = rf"(?U)(?:(?:{_LINKS})\s+|\s{{30}})$"
#: Characters beside a span that an extension looks at.
REACH = 600

# Particles of names, words that name institutions, words that name nobody, and states.
PARTICLES = ("de", "da", "do", "das", "dos", "e", "di", "del", "von", "san")
INSTITUTIONS = (
    "ministerio delegacia promotoria procuradoria defensoria corregedoria ouvidoria judiciario tribunal secretaria governo prefeitura penitenciaria "
    "presidio batalhao juizado comarca superintendencia coordenadoria diretoria departamento autarquia policia conselho instituto fundacao "
    "universidade faculdade gabinete cartorio forum nucleo destacamento bombeiros cadeia republica assembleia senado"
).split()
NO_NAMES = (
    "data hora movimentacao movimentacoes classe assunto assuntos processo numero documento documentos tipo descricao situacao status codigo nome "
    "parte partes autor autora reu re vitima testemunha advogado advogada informado informada nao sim assinado assinada certidao certidoes "
    "protocolo anexo anexos fls fl pagina paginas total valor observacao observacoes endereco telefone email cpf rg oab orgao julgador grau "
    "instancia competencia distribuicao juiz juiza promotor promotora delegado delegada escrivao escriva oficial servidor servidora diretor "
    "diretora secretario secretaria autoridade defensor defensora perito perita acusado acusada indiciado indiciada denunciado denunciada "
    "requerente requerido requerida declarante interrogatorio audiencia sentenca decisao despacho peticao mandado oficio inquerito flagrante "
    "prisao preventiva temporaria liberdade provisoria custodia citacao intimacao publicacao trafico drogas entorpecentes condutas afins crime "
    "crimes homicidio roubo furto receptacao lesao corporal ameaca estelionato violencia domestica familiar mulher porte arma fogo associacao "
    "criminosa penal civel criminal execucao pena vara poder justica seguranca regional policial estado municipio municipal federal civil militar "
    "publico publica social defesa geral nacional unica uniao camara seccional comarca distrital bem como que em no na nos nas por para com sem "
    "sob sobre ante apos ate desde entre este esta esse essa aquele aquela seu sua qual quais onde quando outros outras demais"
).split()
STATES = (
    "acre", "alagoas", "amapa", "amazonas", "bahia", "ceara", "distrito federal", "espirito santo", "goias", "maranhao", "mato grosso",
    "mato grosso do sul", "minas gerais", "para", "paraiba", "parana", "pernambuco", "piaui", "rio de janeiro", "rio grande do norte",
    "rio grande do sul", "rondonia", "roraima", "santa catarina", "sao paulo", "sergipe", "tocantins", "brasil",
)

#: Types that name institutions and acts: a deny term inside the span is enough to drop it.
INSTITUTIONAL = ("ORGANIZATION", "LAW", "CASE_LAW", "LOCATION", "DATE_TIME")


def _span(s: Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), s["type"].alias("type"), s["score"].alias("score"))


def _inside(view: Column, s: Column) -> Column:
    return F.substr(view, s["start"] + 1, s["end"] - s["start"])


def extended(view: Column, s: Column) -> Column:
    """D3: a name goes on over particle and capitalised word, to the right and to the left."""
    right = F.regexp_extract(F.substr(view, s["end"] + 1, F.lit(REACH)), _RIGHT, 0)
    before = lambda n: F.substr(view, F.greatest(s["start"] - n, F.lit(0)) + 1, F.least(s["start"], F.lit(n)))
    left = F.when(before(40).rlike(_LINKED), F.regexp_extract(before(REACH), _LEFT, 0)).otherwise("")
    return _span(s, s["start"] - F.length(left), s["end"] + F.length(right))


def extend_persons(view: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.when(s["type"] == "PERSON", extended(view, s)).otherwise(s))


def trim_spans(view: Column, spans: Column, as_found: Iterable[str] = ()) -> Column:
    """Spans begin and end with a letter or digit, but for types that stay ``as_found``; shorter than two characters they go."""
    edge = r"[^\p{L}\p{Nd}]+"

    def trimmed(s: Column) -> Column:
        return let(_inside(view, s), lambda t: F.when(t.rlike(r"^(?s)[\p{L}\p{Nd}](?:.*[\p{L}\p{Nd}])?\z") | s["type"].isin(*as_found), s).otherwise(cut(s, t)))

    def cut(s: Column, t: Column) -> Column:
        left = F.length(F.regexp_extract(t, "^" + edge, 0))
        right = F.length(F.regexp_extract(t, edge + "$", 0))
        return _span(s, s["start"] + left, s["end"] - right)

    return F.filter(F.transform(spans, trimmed), lambda s: s["end"] - s["start"] >= 2)


def apply_deny(view: Column, spans: Column, deny: dict[str, Iterable[str]], containment: str = "word") -> Column:
    """Drop spans that are a deny term of their type or of ``*``; institutional types also where they hold one.

    A leading term and a space are cut off (the longest such term), and the rest is looked up again. ``containment``
    says whether a held term has to stand between word borders (``word``) or not (``substring``).
    """
    if containment not in ("word", "substring"):
        raise ValueError("containment is word or substring")
    if not any(deny.values()):
        return spans

    every = set(deny.get("*", ()))

    def terms(kind: Column, padded: bool = False) -> Column:
        """The normalised terms of a type, as literals; with a space on both sides where ``padded``."""
        write = lambda own: words_array(sorted({f" {t} " if padded else t for t in map(plain_norm, own) if t})).cast("array<string>")
        out = write(every)
        for t in sorted(set(deny) - {"*"}):
            out = F.when(kind == t, write(set(deny[t]) | every)).otherwise(out)
        return out

    def judged(s: Column) -> Column:
        return let(norm(_inside(view, s)), lambda n: kept(s, n))

    def kept(s: Column, n: Column) -> Column:
        if containment == "substring":
            holds = F.exists(terms(s["type"]), lambda t: n.contains(t))
        else:
            holds = let(F.concat(F.lit(" "), F.regexp_replace(n, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), lambda p: F.exists(terms(s["type"], True), lambda t: p.contains(t)))
        gone = F.array_contains(terms(s["type"]), n) | (s["type"].isin(*INSTITUTIONAL) & holds)
        heads = F.filter(terms(s["type"], True), lambda t: F.concat(F.lit(" "), n).startswith(t))
        cut = F.coalesce(F.array_max(F.transform(heads, lambda t: F.length(t))), F.lit(1)) - 1

        def rest(cut: Column) -> Column:
            tail = F.trim(F.substr(n, cut + 1))
            none = gone | ((cut > 0) & (F.array_contains(terms(s["type"]), tail) | (F.length(tail) <= 1)))
            return F.when(~none, _span(s, s["start"] + cut, s["end"]))

        return let(cut, rest)

    # A span can hold, be or begin with a term only where the text has the term, in its own signs or with spaces for them.
    every_term = sorted({t for own in deny.values() for t in map(plain_norm, own) if t})
    if any(c in t for t in every_term for c in "σς"):  # their lower case hangs on what stands beside them
        return F.filter(F.transform(spans, judged), lambda s: s.isNotNull())
    held = lambda n: F.exists(words_array(every_term), lambda t: n.contains(t))
    known = let(norm(view), lambda n: held(n) | held(F.regexp_replace(n, r"[^\p{L}\p{N}]+", " "))) if every_term else F.lit(False)
    return F.when(known, F.filter(F.transform(spans, judged), lambda s: s.isNotNull())).otherwise(spans)


#: A normalised name of letters in which no word ends a block or bears no name, but for particles inside.
_NO_WORDS = trie_pattern([w for w in [*INSTITUTIONS, *STATES, *NO_NAMES] if " " not in w])
_WHOLE_BLOCK = rf"^(?!{trie_pattern(STATES)}$)(?!{trie_pattern(PARTICLES)}(?: |$))(?=[a-z]{{2}})(?:(?!{_NO_WORDS} )[a-z]+ )*(?!{_NO_WORDS}$)(?!{trie_pattern(PARTICLES)}$)[a-z]{{2,}}$"


def clip_institutions(view: Column, spans: Column) -> Column:
    """A PERSON span shrinks to its longest block of words that can name somebody; without one it goes.

    Words of institutions and states end a block. A block begins and ends with words that bear a name, and needs two
    of them where the span also names an institution.
    """
    none = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("n"), F.lit(-1).alias("x"), F.lit(-1).alias("y"))

    def word(w: Column) -> Column:
        judged = lambda n: F.struct(n.alias("n"), w["a"].alias("a"), (w["a"] + F.length(w["m"])).alias("b"), one_of(n, [*INSTITUTIONS, *STATES]).alias("stops"), (~one_of(n, [*NO_NAMES, *PARTICLES]) & (F.length(n) > 1)).alias("bears"))
        return let(norm(w["m"]), judged)

    def clipped(s: Column) -> Column:
        # Most names are one block, which one pattern tells; only the others are cut into words.
        whole = let(_inside(view, s), lambda t: let(norm(t), lambda n: (F.length(n) == F.length(t)) & (F.length(t) == s["end"] - s["start"]) & n.rlike(_WHOLE_BLOCK)))
        return F.when(whole, s).otherwise(cut(s))

    def cut(s: Column) -> Column:
        return let(F.transform(_matches(_inside(view, s), r"(?U)\w+"), word), lambda words: shrunk(s, words))

    def shrunk(s: Column, words: Column) -> Column:
        need = F.when(F.exists(words, lambda w: one_of(w["n"], INSTITUTIONS)), 2).otherwise(1)

        def longest(need: Column) -> Column:
            def step(acc: Column, w: Column) -> Column:
                a, n = F.when(acc["a"] < 0, w["a"]).otherwise(acc["a"]), acc["n"] + 1
                better = (n >= need) & (w["b"] - a > acc["y"] - acc["x"])
                grown = F.struct(a.alias("a"), w["b"].alias("b"), n.alias("n"), F.when(better, a).otherwise(acc["x"]).alias("x"), F.when(better, w["b"]).otherwise(acc["y"]).alias("y"))
                over = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("n"), acc["x"].alias("x"), acc["y"].alias("y"))
                return F.when(w["stops"], over).when(w["bears"], grown).otherwise(acc)

            return F.aggregate(words, none, step)

        state = F.array_join(F.transform(words, lambda w: w["n"]), " ")
        return let(let(need, longest), lambda best: F.when((best["x"] >= 0) & ~one_of(state, STATES), _span(s, s["start"] + best["x"], s["start"] + best["y"])))

    return F.filter(F.transform(spans, lambda s: F.when(s["type"] == "PERSON", clipped(s)).otherwise(s)), lambda s: s.isNotNull())


def name_blocks(name: Column, particles: Iterable[str] = PARTICLES) -> Column:
    """All blocks of two or more words of a name that neither begin nor end with a particle and have two significant words."""
    words = F.filter(F.split(F.regexp_replace(name, r"(?U)\s+", " "), " "), lambda t: t != "")
    small = lambda t: F.lower(t).isin(*particles)
    judged = F.transform(words, lambda t: F.struct(t.alias("t"), small(t).alias("small"), (~norm(t).isin(*particles) & (F.length(t) > 1)).alias("counts")))

    def blocks(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        found = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.slice(tokens, i, j - i + 1))))
        good = F.filter(found, lambda b: ~F.element_at(b, 1)["small"] & ~F.element_at(b, -1)["small"] & (F.size(F.filter(b, lambda t: t["counts"])) >= 2))
        return F.transform(good, lambda b: F.transform(b, lambda t: t["t"]))

    return let(judged, blocks)


def certain_names(text: Column, spans: Column, min_score: float = CERTAIN) -> Column:
    """The distinct names of at least six characters among the spans, with single spaces."""
    sure = F.filter(spans, lambda s: (s["type"] == "PERSON") & (s["score"] >= min_score))
    return F.filter(F.array_distinct(F.transform(sure, lambda s: F.trim(F.regexp_replace(_inside(text, s), r"(?U)\s+", " ")))), lambda n: F.length(n) >= 6)


def pattern_of(docs: DataFrame, names: str) -> DataFrame:
    """Add ``__rx``, one alternation of all blocks of the names in a column, longest first; null without any."""
    out = docs.withColumn("__names", F.array_distinct(F.flatten(F.transform(names, lambda n: F.transform(name_blocks(n), lambda b: F.array_join(b, " "))))))
    out = out.withColumn("__names", F.array_sort(F.transform("__names", lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b")))))
    branches = F.transform("__names", lambda x: F.array_join(F.transform(F.split(x["b"], " "), quoted), r"\s{1,40}"))
    return out.withColumn("__rx", F.when(F.size("__names") > 0, F.concat(F.lit("(?iu)"), F.array_join(branches, "|")))).drop("__names")


def with_name_pattern(docs: DataFrame, text: Column, min_score: float = CERTAIN) -> DataFrame:
    """Add ``__rx``, one alternation of all blocks of a document's certain names, longest first; null without any."""
    return pattern_of(docs.withColumn("__sure", certain_names(text, F.col("spans"), min_score)), "__sure").drop("__sure")


def with_pattern_spans(docs: DataFrame, text: Column, kind: str, score: float) -> DataFrame:
    """Add ``__spread``, the spans of the matches of the pattern column ``__rx`` in the text; a null pattern has none."""
    found = F.when(F.col("__rx").isNotNull(), marked_matches(unmarked(text), F.col("__rx")))
    span = lambda x: F.struct(x["a"].alias("start"), (x["a"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("type"), F.lit(score).cast("double").alias("score"))
    return docs.withColumn("__spread", F.coalesce(F.transform(found, span), F.array()).cast(SPANS))
