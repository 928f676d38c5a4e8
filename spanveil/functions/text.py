"""Text functions as Columns (F1 to F18 of the survey). No Python code runs on the executors."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letter that is left without the mark.
_MARKED = "áàâãäåāăąéèêëēĕėęěíìîïĩīĭįóòôõöōŏőúùûüũūŭůűųçćĉċčñńņňýÿŷšśŝşžźżřŕŗťţďĺļľ"
_BARE = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuucccccnnnnyyysssszzzrrrttdlll"
#: Combining marks, which a decomposed text carries behind its letters.
_COMBINING = r"[̀-ͯ]"

# Placeholder label of each entity type.
LABELS = {
    "PERSON": "PESSOA",
    "CPF_BR": "CPF",
    "CNPJ_BR": "CNPJ",
    "RG_BR": "RG",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER_BR": "TELEFONE",
    "PHONE_NUMBER": "TELEFONE",
    "LOCATION": "LOCAL",
    "CEP_BR": "CEP",
    "ENDERECO_BR": "ENDEREÇO",
    "OAB_BR": "OAB",
    "DATE_OF_BIRTH": "NASCIMENTO",
    "NIT_PIS_PASEP": "NIT",
    "NUMERO_PROCESSO_CNJ": "PROCESSO",
    "CONTA_BANCARIA": "CONTA",
}


_MADE: dict[tuple, Column] = {}


def made_once(key: Hashable, make: Callable[[], Column]) -> Column:
    """The Column of ``make()``, kept by its key for later plans of the process.

    Writing the larger expressions takes the driver seconds, and they name columns only, not a table. The key has to tell
    all that they depend on. Columns belong to the gateway that made them.
    """
    at = (id(SparkContext._gateway), key)
    if at not in _MADE:
        _MADE[at] = make()
    return _MADE[at]


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once and written once."""
    return F.transform(F.array(value), f)[0]


def trie_pattern(words) -> str:
    """A pattern of plain words that branches letter by letter, so a match tries the letters of a place, not every word."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [("\\." if c == "." else c) + (trie_pattern(rest) if rest != [""] else "") for c, rest in heads.items() if c]
    if "" in heads:
        return f"(?:{'|'.join(parts)})?" if parts else ""
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def one_of(c: Column, words) -> Column:
    """Membership in a list of plain words, as one pattern instead of one literal a word."""
    return c.rlike("^(?:" + trie_pattern(words) + ")$")


def plain_norm(text: str) -> str:
    """``norm`` of a plan-time string."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.strip().lower()) if not unicodedata.combining(c))


def linear_view(c: Column) -> Column:
    """line breaks and tabs as spaces; the length stays."""
    return F.translate(c, "\n\r\t", "   ")


#: Marks around matches, and what stands for them where a text holds them itself: all three are of private use, so no pattern tells them apart.
OPEN, CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


def unmarked(c: Column) -> Column:
    """A text without marks; the length stays."""
    return F.translate(c, OPEN + CLOSE, _OTHER * 2)


def search_view(c: Column) -> Column:
    """The linear view without marks, as it is searched."""
    return F.translate(c, "\n\r\t" + OPEN + CLOSE, "   " + _OTHER * 2)


def marked_matches(text: Column, rx: Column | str) -> Column:
    """All matches of a pattern in a text without marks, with their starts: array of (m, a).

    One pass of the pattern puts marks around its matches, and the text is cut at these: ``split`` by the pattern itself
    would compile it for every row and search once more.
    """
    parts = F.split(F.regexp_replace(text, rx if isinstance(rx, Column) else F.lit(rx), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    kind = "struct<at:int,out:array<struct<m:string,a:int>>>"

    def placed(parts: Column) -> Column:
        start = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<m:string,a:int>>").alias("out")).cast(kind)

        def step(acc: Column, x: Column) -> Column:
            m = F.substring_index(x, CLOSE, 1)
            return F.struct((acc["at"] + F.length(x) - 1).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("m"), acc["at"].alias("a")))).alias("out"))

        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), start, step)["out"]

    # Most texts hold a pattern once, if at all, and one match needs no sum of lengths.
    def one(parts: Column) -> Column:
        return F.array(F.struct(F.substring_index(parts[1], CLOSE, 1).alias("m"), F.length(parts[0]).alias("a")))

    none = F.array().cast("array<struct<m:string,a:int>>")
    found = lambda p: F.filter(F.when(F.size(p) == 2, one(p)).otherwise(placed(p)), lambda x: x["m"] != "")
    return let(parts, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _MARKED + _MARKED.upper(), _BARE + _BARE.upper()), _COMBINING, "")


def plain(c: Column) -> Column:
    """Whether a text is of ASCII alone: it has no accents, and as many bytes as characters."""
    return F.octet_length(c) == F.length(c)


def norm(c: Column) -> Column:
    """trimmed, lower case, without accents."""
    marked = without_accents(F.lower(F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")))
    return F.when(plain(c), F.lower(F.btrim(c, F.lit(" \t\n\x0b\f\r")))).otherwise(marked)


def value_key(c: Column) -> Column:
    """norm with inner white space as one space."""
    return F.trim(F.regexp_replace(norm(c), r"(?U)\s+", " "))


def _stem_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) in order: a plural, then an adverb's ending, then a last vowel; three letters stay at least.

    Plurals: -oes and -aes (-ao), -ais, -eis and -ois (-al, -el, -ol), -ns (-m), -res and -zes (-r, -z), -s. A word has one
    of these endings, so endings of one kind share a pass.
    """
    plurals = [(r"\b([a-z]{3,}?)[oa]es\b", "{1}ao"), (r"\b([a-z]{3,}?)([aeo])is\b", "{1}{2}l"), (r"\b([a-z]{3,}?)ns\b", "{1}m"), (r"\b(?:([a-z]{3,}?[rz])es|([a-z]{3,}?)s)\b", "{1}{2}")]
    return [*plurals, (r"\b([a-z]{3,}?)mente\b", "{1}"), (r"\b([a-z]{3,})[aeo]\b", "{1}")]


def stems(c: Column) -> Column:
    """The words of a normalised text without the endings of number, gender and adverbs."""
    for rx, new in _stem_rules():
        c = F.regexp_replace(c, rx, new.replace("{1}", "$1").replace("{2}", "$2"))
    return c


def plain_stems(text: str) -> str:
    """``stems`` of a plan-time string."""
    import re

    for rx, new in _stem_rules():
        text = re.sub(rx, new.replace("{1}", r"\1").replace("{2}", r"\2"), text)
    return text


def token_key(c: Column) -> Column:
    """no outer punctuation, no accents, lower case."""
    return F.lower(F.btrim(without_accents(c), F.lit(".,;:()[]")))


def digits(c: Column) -> Column:
    """the ASCII digits of a text."""
    return F.regexp_replace(c, "[^0-9]", "")


def all_same(c: Column) -> Column:
    return c == F.repeat(F.substring(c, 1, 1), F.length(c))


#: Letters of a word in capitals, and the words that may stand between two of them.
_CAPS = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
_CAPS_RUN = rf"\b[{_CAPS}]{{2,}}(?:(?:\s+(?:DE|DA|DO|DOS|DAS|E|DI|DEL|VON)\s+|\s+)[{_CAPS}]{{2,}})+\b"


def caps_to_title(c: Column) -> Column:
    """runs of two or more words in capitals get capitals at word starts only; the length stays."""
    rx = "(?U)" + _CAPS_RUN
    runs, gaps = F.regexp_extract_all(c, F.lit(rx), F.lit(0)), F.split(c, rx, -1)
    titled = F.transform(runs, lambda r: F.initcap(r))
    return F.when(c.rlike(rx), F.array_join(F.zip_with(gaps, titled, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")).otherwise(c)


def label_of(c: Column) -> Column:
    """the placeholder label of a type; an unknown type is its own label."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def weight(c: Column) -> Column:
    """F8: letters and digits of a value; below 3 it is too weak to look for."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def quoted(c: Column) -> Column:
    """A value as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def boundary_pattern(value: Column, body: Column) -> Column:
    """``body`` with look-arounds: no letter beside an outer letter, no digit beside an outer digit."""
    kind = lambda ch, side: F.when(ch.rlike(r"\p{L}"), rf"(?{side}\p{{L}})").when(ch.rlike(r"\p{N}"), rf"(?{side}\p{{N}})").otherwise("")
    return F.concat(kind(F.substring(value, 1, 1), "<!"), body, kind(F.substring(value, -1, 1), "!"))


def tolerant_pattern(value: Column) -> Column:
    """A pattern for a value whatever its case, accents and white space."""
    letters = {"a": "aáàâãäå", "e": "eéèêë", "i": "iíìîï", "o": "oóòôõö", "u": "uúùûü", "c": "cç", "n": "nñ"}
    out = F.regexp_replace(value_key(value), r"([^\p{L}\p{N} ])", r"\\$1")
    for bare, marked in letters.items():
        out = F.regexp_replace(out, f"(?<!\\\\){bare}", f"[{marked}{marked[1:].upper()}{bare.upper()}]")
    return F.concat(F.lit("(?iu)"), F.regexp_replace(out, " ", r"\\s+"))


def sha_of(c: Column) -> Column:
    """hash of the normalised value; its first 12 characters are the key."""
    return F.sha2(value_key(c), 256)


def estimate_tokens(c: Column) -> Column:
    """a text's tokens, at 3.2 characters each."""
    return F.ceil(F.length(c) / 3.2).cast("long")


def json_escaped(c: Column) -> Column:
    """a value as it stands inside a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)


def wilson_lower(k: Column, n: Column, z: float = 1.645) -> Column:
    """one-sided lower bound of a proportion; null without trials."""
    p = k / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)))


def output_name(name: Column, fmt: str) -> Column:
    """SNK1: the name of a masked file; the extension tells what it holds."""
    if fmt not in ("md", "txt", "docx"):
        raise ValueError(f"unknown format: {fmt}")
    return F.concat(F.regexp_replace(name, r"\.[^./\\]+$", ""), F.lit(f"_anonimizado.{fmt}"))


def strip_image_refs(c: Column) -> Column:
    """SRC5: without references to images."""
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")


# Names that an OCR language goes by.
_LANGUAGES = {"pt": "por", "pt-br": "por", "por": "por", "en": "eng", "eng": "eng", "es": "spa", "spa": "spa", "la": "latin", "latin": "latin"}


def ocr_language(c: Column, default: str = "por") -> Column:
    """the language model that a language name stands for."""
    table = F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.lit(default))
