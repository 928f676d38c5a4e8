"""Masks of values as Columns (M1 to M15): one expression per entity type, picked by a CASE on the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits

POLICIES = ("placeholder", "parcial", "total")

# Street types in front of an address.
STREET_TYPES = (
    r"Rua|RUA|R\.|Avenida|AVENIDA|Av\.|AV\.|Travessa|TRAVESSA|Trav\.|Alameda|Al\.|Estrada|ESTRADA|Rodovia|Rod\.|Sítio|SÍTIO|Sitio|SITIO|"
    r"Distrito|DISTRITO|Localidade|LOCALIDADE|Conjunto|Conj\.|Praça|PRAÇA|Praca|Vila|VILA|Loteamento|Assentamento|Povoado|Fazenda|Quadra"
)


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def cover(c: Column) -> Column:
    return stars(F.length(c))


def _hide_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "*")


def _head(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), stars(F.length(c) - n))


def person(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 1, w).otherwise(_head(w, 1))), " ")


def cpf(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 11, F.concat(F.substring(d, 1, 3), F.lit(".***.***-"), F.substring(d, -2, 2))).otherwise(cover(c))


def cnpj(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, F.concat(F.substring(d, 1, 2), F.lit(".***/****-"), F.substring(d, -2, 2))).otherwise(cover(c))


def rg(c: Column) -> Column:
    tail = F.substring_index(c, "-", -1)
    base = F.substr(c, F.lit(1), F.length(c) - F.length(tail) - 1)
    return F.when(c.contains("-"), F.concat(_hide_digits(base), F.lit("-"), tail)).otherwise(F.concat(stars(F.length(c) - 1), F.substring(c, -1, 1)))


def email(c: Column) -> Column:
    local = F.substring_index(c, "@", 1)
    rest = F.substr(c, F.length(local) + 1)
    return F.when(~c.contains("@"), cover(c)).otherwise(F.concat(F.when(F.length(local) <= 2, local).otherwise(_head(local, 2)), rest))


def phone(c: Column) -> Column:
    n = F.length(digits(c))
    seen = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, ch: Column) -> Column:
        number = ch.rlike("^[0-9]$")
        shown = acc["i"].isin(0, 1) | (acc["i"] >= n - 2)
        return F.struct(F.when(number, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["out"], F.when(number & ~shown, "*").otherwise(ch)).alias("out"))

    return F.when(n < 10, _hide_digits(c)).otherwise(F.aggregate(F.split(c, ""), seen, step)["out"])


def location(c: Column) -> Column:
    return F.when(F.length(c) <= 2, c).otherwise(_head(c, 2))


def cep(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 8, F.concat(F.substring(d, 1, 2), F.lit("***-***"))).otherwise(cover(c))


def address(c: Column) -> Column:
    prefix = F.regexp_extract(c, rf"(?U)^\s*(?:{STREET_TYPES})\s+", 0)
    return F.concat(prefix, stars(F.length(c) - F.length(prefix)))


def oab(c: Column) -> Column:
    prefix = F.regexp_extract(c, r"(?iuU)^OAB[/\s]?\w{2}[/\s]?", 0)
    return F.concat(prefix, stars(F.length(c) - F.length(prefix)))


def birth_date(c: Column) -> Column:
    year = F.regexp_extract(c, r"^[0-9]{2}/[0-9]{2}/([0-9]{4})", 1)
    return F.when(year != "", F.concat(F.lit("**/**/"), year)).otherwise(cover(c))


def nit(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 4, F.concat(F.substring(d, 1, 3), F.lit(".*****."), F.substring(d, -3, 2), F.lit("-*"))).otherwise(cover(c))


def case_number(c: Column) -> Column:
    seen = F.regexp_extract(c, r"^[0-9]{7}-[0-9]{2}(\.[0-9]{4}\.[0-9]\.[0-9]{2})\.[0-9]{4}", 1)
    return F.when(seen != "", F.concat(F.lit("*******-**"), seen, F.lit(".****"))).otherwise(cover(c))


#: Partial masks by type (U2: add or replace entries); any other type is covered.
MASKS = {
    "PERSON": person,
    "CPF_BR": cpf,
    "CNPJ_BR": cnpj,
    "RG_BR": rg,
    "EMAIL_ADDRESS": email,
    "PHONE_NUMBER_BR": phone,
    "LOCATION": location,
    "CEP_BR": cep,
    "ENDERECO_BR": address,
    "OAB_BR": oab,
    "DATE_OF_BIRTH": birth_date,
    "NIT_PIS_PASEP": nit,
    "NUMERO_PROCESSO_CNJ": case_number,
    "CONTA_BANCARIA": _hide_digits,
}


def check_policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"unknown mask policy {policy!r}; one of {', '.join(POLICIES)}")
    return policy


def mask(kind: Column, text: Column, policy: str = "parcial", masks: dict | None = None) -> Column:
    """The mask of a value by its type; policy ``total`` covers it. Placeholders need numbers: see operators.masking."""
    if check_policy(policy) == "total":
        return cover(text)
    out = F.when(F.lit(False), text)
    for name, f in (masks or MASKS).items():
        out = out.when(kind == name, f(text))
    return out.otherwise(cover(text))
