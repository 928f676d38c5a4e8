"""Pattern recognisers as data (R1 to R15), and detection as Column expressions.

A specification compiles into one expression that yields the spans of a text. First every match is found in the linear
view whatever its case. A value inside its anchor is then cut out with a case-sensitive search in the match; where
that finds nothing, the whole match stays. No shuffle, no Python code on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, made_once, marked_matches, norm, one_of, plain_norm, plain_stems, search_view, stems, token_key, trie_pattern
from ..functions.validators import card_valid, cnj_valid, cnpj_valid, cpf_valid, pis_valid

SPANS = "array<struct<start:int,end:int,type:string,score:double>>"
THRESHOLD = 0.35
#: Score from which on a name is looked for in the rest of its document.
CERTAIN = 0.4
CONTEXT_TOKENS, CONTEXT_GAIN, CONTEXT_FLOOR = 5, 0.35, 0.4


@dataclass(frozen=True)
class PatternSpec:
    """One pattern of one entity type (U1). With ``value`` the span is that part, between ``regex`` and ``after``.

    ``needs`` is a cheap pattern without which a text cannot match: texts without it are not searched. ``shape`` is a
    string that every match holds once its digits are written as 0: it is looked for before the pattern. An ``exact`` pattern
    heeds case, and its classes are those of ASCII.

    ``scan`` stands for ``regex``, and ``first`` before it, where a text is searched: they find the same matches and fail sooner
    at the places in between, of which there are far more. A pattern that is ``likely`` where its ``shape`` or ``needs`` is
    found is not searched for a first hit before all its matches are.
    """

    type: str
    name: str
    regex: str
    score: float
    value: str | None = None
    after: str = ""
    validator: Callable[[Column], Column] | None = None
    boost: float = 0.95
    check_required: bool = False
    context: tuple[str, ...] = ()
    cut_name: bool = False
    needs: str = "[0-9]"
    shape: str = ""
    exact: bool = False
    first: str = ""
    scan: str = ""

    @property
    def likely(self) -> bool:
        return len(self.shape) >= 10 or self.needs == "@"

    def whole(self) -> str:
        found = self.scan or self.regex
        return ("(?sm)" if self.exact else "(?iuUsm)") + self.first + (found if self.value is None else f"(?:{found})(?:{self.value})(?:{self.after})")

    def inner(self) -> str:
        return rf"(?uUs)^(.*?(?:{self.regex}))({self.value})(?:{self.after})"


# Context words by type.
CONTEXT = {
    "CPF_BR": ("cpf", "cadastro de pessoa física", "cadastro", "documento", "inscrição"),
    "CNPJ_BR": ("cnpj", "empresa", "razão social", "pessoa jurídica", "inscrição"),
    "RG_BR": ("rg", "registro geral", "identidade", "cédula de identidade", "carteira de identidade", "ssp"),
    "CEP_BR": ("cep", "código postal", "endereço", "logradouro", "bairro", "rua", "avenida"),
    "ENDERECO_BR": ("residente", "domiciliado", "domiciliada", "reside", "endereço", "endereco", "logradouro", "bairro", "morador", "moradora", "situado", "situada", "localizado", "localizada", "com endereço na", "rua", "avenida"),
    "PHONE_NUMBER_BR": ("telefone", "celular", "fone", "contato", "whatsapp", "tel", "ramal"),
    "OAB_BR": ("oab", "advogado", "advogada", "inscrição"),
    "DATE_OF_BIRTH": ("nascimento", "nascido", "nascida", "data de nascimento", "dt. nasc", "dt nasc", "nasc.", "natural de"),
    "NIT_PIS_PASEP": ("pasep", "previdência", "inss", "benefício", "número de inscrição"),
    "NUMERO_PROCESSO_CNJ": ("processo", "autos", "ação", "número", "nº"),
    "CONTA_BANCARIA": ("banco", "agência", "conta", "conta corrente", "conta poupança", "bancário", "bancária"),
    "EMAIL_ADDRESS": ("email", "e-mail", "correio", "endereço eletrônico"),
}

# The patterns and scores of the recognisers.
_NAME = r"[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-Za-zÁ-Úá-úÀ-ÿÇç']+(?:\s{1,30}(?:d[aeo]s?|D[AEO]S?|e|E)?\s{0,30}[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-Za-zÁ-Úá-úÀ-ÿÇç']+){1,5}"
_ROLES = (
    r"REQUERENTE|REQUERIDO|REQUERIDA|ACUSADO|ACUSADA|DENUNCIADO|DENUNCIADA|INDICIADO|INDICIADA|INVESTIGADO|INVESTIGADA|V[ÍI]TIMA|OFENDIDO|"
    r"OFENDIDA|TESTEMUNHA|DECLARANTE|DEPOENTE|AUTOR|AUTORA|R[ÉE]U|R[ÉE]|EXEQUENTE|EXECUTADO|EXECUTADA|ADV|ADVOGADO|ADVOGADA|DEFENSOR|"
    r"DEFENSORA|QUERELANTE|QUERELADO|Requerente|Requerido|Requerida|Acusado|Acusada|Denunciado|Denunciada|Indiciado|Indiciada|V[íi]tima|"
    r"Testemunha|Declarante|Autor|Autora|R[ée]u|Advogado|Advogada"
)
#: The roles whatever their case, letter by letter.
_ANY_ROLE = (
    r"a(?:cusad[oa]|utora?|dv(?:ogad[oa])?)|de(?:nunciad[oa]|clarante|poente|fensora?)|exe(?:quente|cutad[oa])|in(?:diciad[oa]|vestigad[oa])|"
    r"ofendid[oa]|querela(?:nte|do)|r(?:equer(?:ente|id[oa])|[ée]u?)|testemunha|v[íi]tima"
)
#: The street types (``STREET_TYPES``) likewise.
_ANY_STREET = (
    r"r(?:ua|\.|od(?:ovia|\.))|a(?:v(?:enida|\.)|l(?:ameda|\.)|ssentamento)|trav(?:essa|\.)|estrada|s[íi]tio|distrito|lo(?:calidade|teamento)|"
    r"conj(?:unto|\.)|p(?:ra[çc]a|ovoado)|vila|fazenda|quadra"
)
REGISTRY: tuple[PatternSpec, ...] = (
    PatternSpec("CPF_BR", "cpf_fmt", r"(?<!\d)\d{3}\.\d{3}\.\d{3}\s{0,30}-\s{0,30}\d{2}", 0.6, validator=cpf_valid, shape="000.000.000", first=r"(?=\d)"),
    PatternSpec("CPF_BR", "cpf_espacado", r"(?<![\d.])\d{3}[.\s]\s{0,3}\d{3}[.\s]\s{0,3}\d{3}\s{0,3}-\s{0,3}\d{2}(?!\d)", 0.55, validator=cpf_valid, first=r"(?=\d)"),
    PatternSpec("CPF_BR", "cpf_fmt_ocr", r"\b[\dOoIlSBgq]{3}\.[\dOoIlSBgq]{3}\.[\dOoIlSBgq]{3}-[\dOoIlSBgq]{2}\b", 0.55, validator=cpf_valid, first=r"(?=[\dOoIlSBgq]{3}\.)"),
    PatternSpec("CPF_BR", "cpf_raw", r"(?<!\d)\d{11}(?!\d)", 0.3, validator=cpf_valid, check_required=True, shape="00000000000"),
    PatternSpec("CNPJ_BR", "cnpj_fmt", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", 0.6, validator=cnpj_valid, shape="00.000.000/0000-00"),
    PatternSpec("CNPJ_BR", "cnpj_raw", r"(?<!\d)\d{14}(?!\d)", 0.3, validator=cnpj_valid, check_required=True, shape="00000000000000"),
    PatternSpec(
        "RG_BR", "rg_ancorado",
        r"(?:RG|R\.\s?G\.?|[Rr]egistro\s+[Gg]eral|[Ii]dentidade|[Cc][ée]dula\s+de\s+[Ii]dentidade|[Cc]arteira\s+de\s+[Ii]dentidade)[\s.:n°ºo/-]{0,24}",
        0.85, value=r"\d[\d.\s-]{4,16}[\dXx]", after=r"(?=\s*(?:SSP|SESP|DETRAN|PC|IFP|SDS|[^\d]|$))", first="(?=[RIC])",
    ),
    PatternSpec("RG_BR", "rg_com_orgao", "", 0.8, value=r"\d[\d.\s-]{5,16}[\dXx]", after=r"\s*[-/]?\s*(?=(?:SSP|SSPDS|SESP|DETRAN|IFP|SDS)\b)", needs="(?iu)(?=[sdi])(?:s(?:sp|esp|ds)|detran|ifp)"),
    PatternSpec("RG_BR", "rg_fmt", r"(?=\d)\b\d{1,2}\.\d{3}\.\d{3}-[\dxX]\b", 0.7, shape=".000.000-"),
    PatternSpec("CEP_BR", "cep_ancorado", r"CEP[\s.:nºo°-]{0,6}", 0.9, value=r"\d{2}\.?\s?\d{3}[\s.-]{0,3}\d{3}", after=r"(?!\d)"),
    PatternSpec("CEP_BR", "cep_livre", r"(?<![\d-])", 0.45, value=r"\d{2}\.?\d{3}-\d{3}", after=r"(?!\d)", shape="000-000", first=r"(?=\d)"),
    PatternSpec(
        "ENDERECO_BR", "logradouro", rf"(?=[RATESDLCPVFQ])\b(?:{_ANY_STREET})\s+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ0-9][^\n;]{{2,80}}?(?=\s*(?:;|CEP|[Ff]one|[Tt]el|[Ee]-?mail|$|\.\s+[A-ZÁÉÍÓÚ]))", 0.5, needs="",
    ),
    PatternSpec("PHONE_NUMBER_BR", "tel_br_intl", r"\+55\s{0,3}\(?\d{2}\)?[\s.-]{0,30}9?\d{4}[\s.-]{0,3}\d{4}\b", 0.85, shape="+00"),
    PatternSpec("PHONE_NUMBER_BR", "tel_br_parenteses", r"\(\d{2}\)[\s.-]{0,30}\d{4,5}[\s.-]{0,3}\d{4}\b", 0.8, shape="(00)"),
    PatternSpec("PHONE_NUMBER_BR", "tel_br_hifen", r"(?=\d)\b\d{2}[\s.]{0,3}\d{4,5}[\s.-]{0,3}\d{4}\b", 0.7, shape="0000"),
    PatternSpec("OAB_BR", "oab_estado", r"\bOAB(?![A-Za-zÀ-ÿ])\s*[/\-]?\s*[A-Z]{2}\s*[/\-:]?\s*(?:n\.?[ºo°]?\.?)?\s*", 0.9, value=r"\d[\d.]{2,7}\d", after=r"(?!\d)", needs="(?i)oab"),
    PatternSpec("OAB_BR", "oab_generico", r"\bOAB(?![A-Za-zÀ-ÿ])[/\s]?[A-Z]{2}[/\s]?\d[\d.]{3,7}\b", 0.85, needs="(?i)oab"),
    PatternSpec("OAB_BR", "oab_numero_antes", r"\bOAB(?![A-Za-zÀ-ÿ])[\s.:nºo°-]{0,4}", 0.9, value=r"\d[\d.]{2,7}", after=r"\s*/\s*[A-Z]{2}\b", needs="(?i)oab"),
    PatternSpec("DATE_OF_BIRTH", "data_nasc_ancorada", r"(?:nascid[oa]\s+em|nascimento|nasc\.?|dt\.?\s*nasc\.?|data\s+de\s+nascimento)[\s.:nºo°-]{0,8}", 0.85, value=r"\d{2}/\d{2}/\d{4}", shape="00/00/0000", first="(?=[ND])"),
    PatternSpec("DATE_OF_BIRTH", "data_nasc", r"\b\d{2}/\d{2}/\d{4}\b", 0.20, shape="00/00/0000", first=r"(?=\d)"),
    PatternSpec("NIT_PIS_PASEP", "nit_fmt", r"\b\d{3}\.\d{5}\.\d{2}-\d\b", 0.6, validator=pis_valid, boost=0.9, shape="000.00000.00-0"),
    PatternSpec("NIT_PIS_PASEP", "nit_raw", r"(?<!\d)\d{11}(?!\d)", 0.3, validator=pis_valid, boost=0.9, check_required=True, shape="00000000000"),
    PatternSpec("NUMERO_PROCESSO_CNJ", "processo_cnj_fmt", r"(?<!\d)\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", 0.75, validator=cnj_valid, boost=0.98, shape="0000000-00.0000.0.00.0000", first=r"(?=\d)"),
    PatternSpec("NUMERO_PROCESSO_CNJ", "processo_cnj_raw", r"(?<!\d)\d{20}(?!\d)", 0.3, validator=cnj_valid, boost=0.98, check_required=True, shape="00000000000000000000"),
    PatternSpec("CONTA_BANCARIA", "conta_ag_cc", r"(?=[Aa])\b[Aa]g(?:[êe]ncia)?[:\s]*\d{3,5}[\s,\-]*(?:[Cc](?:onta)?[:\s]*|[Cc]{2}[:\s]*|[Cc][Pp][:\s]*)\d{4,12}-?\d?\b", 0.75, shape="000"),
    PatternSpec("EMAIL_ADDRESS", "email_tld_grudado", "", 0.85, value=r"[A-Za-z0-9._%+-]++@(?:[a-z0-9-]+\.)+[a-z]{2,}", after=r"(?![a-z])", needs="@", scan=r"\G|(?<![A-Za-z0-9._%+-])"),
    PatternSpec("PERSON", "nome_apos_rotulo", rf"(?=[RADIVOTEQ])(?:{_ROLES})\s*(?:\([as]\))?\s*:\s*", 0.8, value=_NAME, cut_name=True, needs=":", scan=rf"(?=[RADIVOTEQ])(?:{_ANY_ROLE})\s*(?:\([as]\))?\s*:\s*"),
    PatternSpec("PERSON", "nome_assinatura", r"assinado\s+digitalmente\s+por\s+", 0.8, value=_NAME, cut_name=True, needs="(?i)assinado"),
)

#: E-mails as the plain pattern has them: case counts, and nothing behind them is looked at.
PLAIN_EMAILS: tuple[PatternSpec, ...] = (PatternSpec("EMAIL_ADDRESS", "email_plain", r"[A-Za-z0-9._%+-]++@(?:[a-z0-9-]+\.)+[a-z]{2,}", 0.85, needs="@", exact=True),)

#: Generic recognisers (R15), of types of their own but for e-mail and phone.
GENERIC: tuple[PatternSpec, ...] = (
    PatternSpec("EMAIL_ADDRESS", "email", r"\b[\w.!#$%&'*+/=?^`{|}~-]{1,64}@\w+(?:[-.]\w+)*\.[a-z]{2,}\b", 0.5, needs="@"),
    PatternSpec("PHONE_NUMBER", "phone_international", r"(?<![\w+])\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,3}\b", 0.4),
    PatternSpec("IP_ADDRESS", "ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])", 0.6),
    PatternSpec(
        "CREDIT_CARD", "card", r"(?<![\d.,/-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -]?)\d{6}\2\d{4,5})(?![\d/-])",
        0.3, validator=card_valid, boost=1.0, check_required=True,
    ),
    PatternSpec("URL", "url", r"\bhttps?://[^\s<>\"']+", 0.5, needs="(?i)https?://"),
)

# Words of procedure at which a labelled name ends.
PROCEDURE_WORDS = (
    "certifico certidao certidão vistos designo conforme denuncia denúncia mandado oficio ofício cota ministerial pedido diligencias diligências "
    "trata considerando inquerito inquérito termo audiencia audiência ata decisao decisão sentenca sentença despacho peticao petição laudo exame "
    "auto autos prisao prisão flagrante boletim ocorrencia ocorrência envio publicacao publicação intimacao intimação citacao citação acordo "
    "alegacoes alegações memoriais requerido requerida requerente acusado acusada vitima vítima testemunha declarante denunciado denunciada "
    "indiciado indiciada advogado advogada reu réu autor autora oficial justica justiça juiz juiza juíza promotor promotora delegado delegada "
    "escrivao escrivão secretaria diretora vara comarca estado poder judiciario judiciário tribunal ministerio ministério publico público "
    "defensoria defensor policia polícia policial militar civil delegacia forum fórum cartorio cartório central nome endereco endereço data hora "
    "local processo numero número classe assunto cpf rg filiacao filiação naturalidade profissao profissão observacoes observações para conferir "
    "protocolado informe codigo código sob esta este não nao informado"
).split()
_PARTICLES = ("de", "da", "do", "das", "dos", "e")


def words_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens_with_gaps(text: Column) -> Column:
    """The tokens of a text and where they start: array of (t, a)."""
    found, gaps = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), F.split(text, r"(?U)\S+", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:string,a:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        return F.struct((a + F.length(x["t"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), a.alias("a")))).alias("out"))

    paired = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda t, g: F.struct(t.alias("t"), g.alias("g")))
    return F.aggregate(paired, start, step)["out"]


def significant(token: Column, particles: Iterable[str] = _PARTICLES) -> Column:
    return ~token_key(token).isin(*particles) & (F.length(token) > 1)


#: A normalised name of letters without a word of procedure, whose first and last words are significant.
_WHOLE_NAME = rf"^(?!(?:{trie_pattern(_PARTICLES)}) )(?=[a-z']{{2}})(?:(?!{trie_pattern(PROCEDURE_WORDS)} )[a-z']+ +)+(?!(?:{trie_pattern([*PROCEDURE_WORDS, *_PARTICLES])})$)[a-z']{{2,}}$"


def cut_labelled_name(text: Column) -> Column:
    """Length of the name before the first word of procedure; null with fewer than two significant words.

    Most names are whole as they are found, which one pattern tells; only the others are cut into tokens.
    """
    whole = let(norm(text), lambda n: (F.length(n) == F.length(text)) & n.rlike(_WHOLE_NAME))
    return F.when(whole, F.length(text)).otherwise(let(tokens_with_gaps(text), _name_length))


def _name_length(tokens: Column) -> Column:
    stop = F.array_position(F.transform(tokens, lambda x: one_of(token_key(x["t"]), PROCEDURE_WORDS)), True)
    kept = F.when(stop > 0, F.slice(tokens, F.lit(1), stop.cast("int") - 1)).otherwise(tokens)


    def length(kept: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(F.size(F.filter(kept, lambda x: significant(x["t"]))) >= 2, last["a"] + F.length(last["t"]))

    return let(kept, length)


def _matches(view: Column, rx: str, needs: str = "", shape: Column | None = None, likely: bool = False) -> Column:
    """All matches with their starts: array of (m, a). ``view`` has no marks (``search_view``, ``unmarked``)."""
    hit = None if likely else view.rlike(rx)
    if needs and not (likely and shape is not None):
        held = view.contains(needs) if needs.isalnum() or needs in ("@", ":") else view.rlike(needs)
        hit = held if hit is None else held & hit
    if shape is not None:
        hit = shape if hit is None else shape & hit
    return F.when(hit, marked_matches(view, rx)).otherwise(F.array().cast("array<struct<m:string,a:int>>"))


def digits_as_zeros(view: Column) -> Column:
    """A text with every digit, of whatever script, as 0: what the shapes of patterns are looked for in."""
    return F.regexp_replace(view, r"\p{Nd}", "0")


def _context_before(view: Column, start: Column) -> Column:
    """The five tokens before a hit, without case, accents and endings.

    The tokens are those of the 200 characters before the hit where these hold more than five, else of all before it.
    """
    # Read from the hit backwards, so the pattern is held at its place and ends with the fifth token.
    back = lambda a, n: F.reverse(F.rtrim(F.substr(view, a, n)))
    last = lambda b: F.regexp_extract(b, rf"^(?U)\S*+(?:\s++\S*+){{0,{CONTEXT_TOKENS - 1}}}", 0)
    near = lambda b: let(last(b), lambda t: F.when((start <= 200) | (F.length(t) < F.length(b)), t).otherwise(last(back(F.lit(1), start))))
    found = let(back(F.greatest(start - 199, F.lit(1)), F.least(start, F.lit(200))), near)
    return stems(let(F.regexp_replace(F.reverse(found), r"(?U)\s+", " "), norm))


def _context_pattern(words: tuple[str, ...]) -> str:
    return "|".join(sorted({plain_stems(plain_norm(w)).replace(".", r"\.") for w in words}))


def _words_of(spec: PatternSpec, context: dict | None) -> tuple[str, ...]:
    return tuple(spec.context or (CONTEXT if context is None else context).get(spec.type, ()))


_RAW = "array<struct<start:int,end:int,type:string,score:double,pattern:int>>"


def _raw_spans(view: Column, zeros: Column, spec: PatternSpec, pattern: int) -> Column:
    """The spans of one specification before their context is looked at; ``pattern`` tells which context words lift them."""

    def scored(m: Column) -> Column:
        score = F.lit(spec.score).cast("double")
        if spec.validator is None:
            return score
        return F.when(spec.validator(m), F.lit(max(spec.score, spec.boost)).cast("double")).otherwise(F.lit(None).cast("double") if spec.check_required else score)

    def made(m: Column, begin: Column, size: Column) -> Column:
        return F.struct(begin.cast("int").alias("start"), (begin + size).cast("int").alias("end"), F.lit(spec.type).alias("type"), scored(m).alias("score"), F.lit(pattern).alias("pattern"))

    def span(x: Column) -> Column:
        m, a = x["m"], x["a"]
        if spec.value is None:
            return made(m, a, F.length(m))

        # The borders are computed once: each use of an expression in a lambda searches the match anew.
        def placed(value: Column) -> Column:
            begin = F.when(value != "", a + F.length(F.regexp_extract(m, spec.inner(), 1))).otherwise(a)
            place = F.struct(begin.alias("a"), F.when(value != "", value).otherwise(m).alias("t"))
            return let(place, lambda p: made(m, p["a"], cut_labelled_name(p["t"]) if spec.cut_name else F.length(p["t"])))

        return let(F.regexp_extract(m, spec.inner(), 2), placed)

    return F.filter(F.transform(_matches(view, spec.whole(), spec.needs, F.contains(zeros, F.lit(spec.shape)) if spec.shape else None, spec.likely), span), lambda s: s["score"].isNotNull() & s["end"].isNotNull()).cast(_RAW)


def _lifted(view: Column, raw: Column, patterns: dict[str, int], threshold: float, scores: bool = True) -> Column:
    """Spans with the scores that context words give them, at or above the threshold.

    Without ``scores`` a span that is certain by its own score keeps it: its context would only raise it.
    """

    def lifted(s: Column) -> Column:
        def near(before: Column) -> Column:
            out = F.lit(False)
            for rx, i in patterns.items():
                out = F.when(s["pattern"] == i, before.rlike(rx)).otherwise(out)
            return out

        score = s["score"]
        if patterns:
            hit = ((score != 1.0) if scores else (score < max(threshold, CERTAIN))) & (s["pattern"] >= 0) & (s["start"] > 0) & let(_context_before(view, s["start"]), near)
            score = F.when(hit, F.least(F.greatest(score + CONTEXT_GAIN, F.lit(CONTEXT_FLOOR)), F.lit(1.0))).otherwise(score)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), score.cast("double").alias("score"))

    return F.filter(F.transform(raw, lifted), lambda s: s["score"] >= threshold)


def _spans_of(view: Column, zeros: Column, specs: Iterable[PatternSpec], threshold: float, context: dict | None, scores: bool = True) -> Column:
    """The spans of all specifications in their order; their context is looked at in one place, so the plan holds it once."""
    specs, patterns, raw = list(specs), {}, []
    for s in specs:
        words = _words_of(s, context)
        at = patterns.setdefault(_context_pattern(words), len(patterns)) if words else -1
        raw.append(_raw_spans(view, zeros, s, at))
    return _lifted(view, F.concat(*raw), patterns, threshold, scores)


def spec_spans(view: Column, spec: PatternSpec, threshold: float = THRESHOLD, context: dict | None = None) -> Column:
    """The spans that one specification finds in a linear view, at or above the threshold."""
    return _spans_of(view, digits_as_zeros(view), [spec], threshold, context)


def supported_entities(specs: Iterable[PatternSpec] = REGISTRY + GENERIC) -> list[str]:
    """U4: the types that the specifications can find."""
    return sorted({s.type for s in specs})


def chosen_specs(entities: Iterable[str] | None, specs: Iterable[PatternSpec]) -> list[PatternSpec]:
    """The specifications of the asked types (all without any); names are stripped, unknown ones are an error."""
    specs = list(specs)
    asked = {e.strip() for e in entities or () if e.strip()}
    unknown = asked - {s.type for s in specs} - {"LOCATION", "ORGANIZATION", "PERSON", "DATE_TIME", "LAW", "CASE_LAW"}
    if unknown:
        raise ValueError(f"unknown entity types: {', '.join(sorted(unknown))}")
    return [s for s in specs if not asked or s.type in asked]


def detect(docs: DataFrame, entities: Iterable[str] | None = None, specs: Iterable[PatternSpec] = REGISTRY, threshold: float = THRESHOLD, context: dict | None = None, scores: bool = True) -> DataFrame:
    """Add ``spans`` to (doc_id, text): every pattern hit of the asked types, on the whole text. A null text has none.

    Without ``scores`` the same spans are found, but the context of a span is read only where it decides whether the span stays.
    """
    chosen = chosen_specs(entities, specs)
    spans = made_once((tuple(chosen), threshold, scores, None if context is None else tuple(sorted((t, tuple(w)) for t, w in context.items()))), lambda: _spans_of(F.col("__view"), F.col("__zeros"), chosen, threshold, context, scores)) if chosen else F.array()
    out = docs.withColumn("__view", F.coalesce(search_view(F.col("text")), F.lit("")))
    out = out.withColumn("__zeros", digits_as_zeros(F.col("__view")))
    return out.withColumn("spans", spans.cast(SPANS)).drop("__view", "__zeros")


def exploded(docs: DataFrame, column: str = "spans") -> DataFrame:
    """One row per span: doc_id, start, end, type, score."""
    rows = docs.select("doc_id", F.explode_outer(column).alias("s")).select("doc_id", "s.start", "s.end", "s.type", "s.score")
    return rows.where("start is not null")


def with_external_spans(docs: DataFrame, model: DataFrame, labels: dict[str, str], low: dict[str, float] | None = None) -> DataFrame:
    """SRC12: add spans of an outside model (doc_id, start, end, label, score) to ``spans`` under our types.

    Labels that ``labels`` does not map are left out. Scores of ORGANIZATION count 0.4 times (``low``).
    """
    low = {"ORGANIZATION": 0.4} if low is None else low
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    kind = F.element_at(table, F.col("label"))
    score = F.col("score").cast("double")
    for t, factor in low.items():
        score = F.when(kind == t, F.col("score") * factor).otherwise(score)
    own = model.select("doc_id", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), kind.alias("type"), score.alias("score")).alias("s"))
    own = own.where("s.type is not null and s.start < s.end").groupBy("doc_id").agg(F.collect_list("s").alias("__more"))
    out = docs.join(own, "doc_id", "left")
    return out.withColumn("spans", F.concat("spans", F.coalesce("__more", F.array().cast(SPANS)))).drop("__more")
