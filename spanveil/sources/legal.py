"""Court-like documents with Brazilian identifiers, derived from the customer table.

The given tables hold no Brazilian identifiers, so queries of those types run on texts that Spark derives, one per
customer, from one SQL text that other engines understand too. ``pieces`` gives the parts of each text in order with the
type that each part is, so the true place of every value is the sum of the lengths before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import dealt


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', '|', CAST(({index}) % {len(words.split('|'))} AS INT) + 1)"


def _sum(expr: str, weights: list[int]) -> str:
    return " + ".join(f"CAST(substr({expr}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


_SEEDS = f"""
SELECT c_custkey AS k,
  {_pick("Alano|Berila|Cassio|Dorvalina|Edgar|Floriza|Gentil|Hedilene", "c_custkey")} || ' ' ||
  {_pick("da|de|dos", "c_custkey")} || ' ' ||
  {_pick("Moura|Queiroz|Siqueira|Teles|Uchoa|Valente|Ximenes|Zanin", "CAST(floor(c_custkey / 8) AS BIGINT)")} || ' ' ||
  {_pick("Barros|Cordeiro|Dutra|Esteves|Fontes|Goulart|Holanda|Ibiapina", "CAST(floor(c_custkey / 64) AS BIGINT)")} AS person,
  lpad(CAST((c_custkey * 7919 + 10203) % 1000000000 AS STRING), 9, '0') AS cpf9,
  lpad(CAST((c_custkey * 104729 + 7) % 100000000 AS STRING), 8, '0') || '0001' AS cnpj12,
  '12' || lpad(CAST((c_custkey * 7877 + 31) % 100000000 AS STRING), 8, '0') AS pis10,
  lpad(CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING), 7, '0') AS case7,
  lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS origin
FROM {{customer}}
"""
_CHECKED = f"""
SELECT *, cpf9 || CAST(cpf_a AS STRING) || CAST((({_sum("cpf9", list(range(11, 2, -1)))} + cpf_a * 2) * 10) % 11 % 10 AS STRING) AS cpf11,
  pis10 || CAST(CASE WHEN pis_s % 11 < 2 THEN 0 ELSE 11 - pis_s % 11 END AS STRING) AS pis11,
  98 - ((CAST(case7 || '2019806' || origin AS BIGINT) % 97) * 100) % 97 AS case_dv,
  cnpj12 || CAST(cnpj_a AS STRING) AS cnpj13
FROM (SELECT *, (({_sum("cpf9", list(range(10, 1, -1)))}) * 10) % 11 % 10 AS cpf_a,
  {_sum("pis10", [3, 2, *range(9, 1, -1)])} AS pis_s,
  CASE WHEN ({_sum("cnpj12", [5, 4, 3, 2, *range(9, 1, -1)])}) % 11 < 2 THEN 0 ELSE 11 - ({_sum("cnpj12", [5, 4, 3, 2, *range(9, 1, -1)])}) % 11 END AS cnpj_a
  FROM ({_SEEDS}) seeds) digits
"""
#: One row per customer with its values; every tenth CPF and case number has a wrong check digit.
VALUES_SQL = f"""
SELECT k, person, CASE WHEN k % 10 = 0 THEN substr(cpf11, 1, 10) || CAST((CAST(substr(cpf11, 11, 1) AS INT) + 1) % 10 AS STRING) ELSE cpf11 END AS cpf_raw,
  k % 10 <> 0 AS cpf_ok,
  CASE WHEN ({_sum("cnpj13", [6, 5, 4, 3, 2, *range(9, 1, -1)])}) % 11 < 2 THEN cnpj13 || '0' ELSE cnpj13 || CAST(11 - ({_sum("cnpj13", [6, 5, 4, 3, 2, *range(9, 1, -1)])}) % 11 AS STRING) END AS cnpj_raw,
  pis11 AS pis_raw, case7 || lpad(CAST(CASE WHEN k % 10 = 0 THEN case_dv % 97 + 1 ELSE case_dv END AS STRING), 2, '0') || '2019806' || origin AS case_raw,
  case_dv % 97 + 1 = case_dv OR k % 10 <> 0 AS case_ok,
  case7 AS case_id,
  lpad(CAST(60000 + k % 9000 AS STRING), 5, '0') || '-' || lpad(CAST(k % 1000 AS STRING), 3, '0') AS cep,
  '85) 9' || lpad(CAST(k % 10000 AS STRING), 4, '0') || '-' || lpad(CAST((k * 31) % 10000 AS STRING), 4, '0') AS phone,
  lpad(CAST(k % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(k % 12 + 1 AS STRING), 2, '0') || '/' || CAST(1950 + k % 50 AS STRING) AS birth,
  'p' || CAST(k AS STRING) || '@correio' || CAST(k % 7 AS STRING) || '.com.br' AS email
FROM ({_CHECKED}) checked
"""
_FORMATTED = f"""
SELECT *, substr(cpf_raw, 1, 3) || '.' || substr(cpf_raw, 4, 3) || '.' || substr(cpf_raw, 7, 3) || '-' || substr(cpf_raw, 10, 2) AS cpf,
  substr(case_raw, 1, 7) || '-' || substr(case_raw, 8, 2) || '.2019.8.06.' || substr(case_raw, 17, 4) AS case_no
FROM ({VALUES_SQL}) vals
"""
#: (place in the text, type or empty, SQL of the part). The last line repeats the name without a label, in capitals.
_PARTS = [
    (1, "", "'REQUERENTE: '"), (2, "PERSON", "person"), (3, "", "', inscrito no CPF sob '"), (4, "CPF_BR", "cpf"),
    (5, "", "'. Processo '"), (6, "NUMERO_PROCESSO_CNJ", "case_no"), (7, "", "'.' || chr(10) || 'Fone ('"), (8, "PHONE_NUMBER_BR", "phone"),
    (9, "", "' e '"), (10, "EMAIL_ADDRESS", "email"), (11, "", "' ; CEP: '"), (12, "CEP_BR", "cep"), (13, "", "chr(10) || 'Data: nascido em '"),
    (14, "DATE_OF_BIRTH", "birth"), (15, "", "'.' || chr(10) || 'Compareceu '"), (16, "PERSON", "upper(person)"), (17, "", "' hoje.'"),
]
PIECES_SQL = " UNION ALL ".join(f"SELECT k AS doc_id, case_id, {i} AS pos, '{t}' AS type, {sql} AS part FROM ({_FORMATTED}) f{i}" for i, t, sql in _PARTS)
DOCS_SQL = f"SELECT k AS doc_id, case_id, {' || '.join(sql for _, _, sql in _PARTS)} AS text FROM ({_FORMATTED}) f"
#: Typed parts with their true places.
TRUTH_SQL = f"""
SELECT doc_id, case_id, type, CAST(fin - length(part) AS INT) AS start, CAST(fin AS INT) AS "end", part AS text
FROM (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos) AS fin FROM ({PIECES_SQL}) pieces) placed WHERE type <> ''
"""


#: A second layout with the other types, values that touch words of procedure, a body that is no person, and overlapping patterns.
_MORE = [
    (1, "", "'AUTOR: '"), (2, "PERSON", "person"), (3, "", "' CERTIFICO que a empresa de CNPJ '"), (4, "CNPJ_BR", "cnpj"), (5, "", "' e a carteira de identidade '"),
    (6, "RG_BR", "rg"), (7, "", "' SSP-CE foram exibidas.' || chr(10) || 'Residente na '"), (8, "ENDERECO_BR", "address"), (9, "", "'; inscrito na OAB/CE nº '"), (10, "OAB_BR", "oab"),
    (11, "", "' e no PIS '"), (12, "NIT_PIS_PASEP", "nit"), (13, "", "'.' || chr(10) || 'Depósito em '"), (14, "CONTA_BANCARIA", "account"),
    (15, "", "'.' || chr(10) || 'TESTEMUNHA: Universidade Federal do Ceará.' || chr(10) || 'Em 12/12/2020 o senhor '"), (16, "PERSON", "upper(person)"), (17, "", "' assinou. Total de 123 itens.'"),
]
_MORE_VALUES = f"""
SELECT *, substr(cnpj_raw, 1, 2) || '.' || substr(cnpj_raw, 3, 3) || '.' || substr(cnpj_raw, 6, 3) || '/' || substr(cnpj_raw, 9, 4) || '-' || substr(cnpj_raw, 13, 2) AS cnpj,
  substr(pis_raw, 1, 3) || '.' || substr(pis_raw, 4, 5) || '.' || substr(pis_raw, 9, 2) || '-' || substr(pis_raw, 11, 1) AS nit,
  lpad(CAST(k % 90 + 10 AS STRING), 2, '0') || '.' || lpad(CAST((k * 37) % 1000 AS STRING), 3, '0') || '.' || lpad(CAST((k * 91) % 1000 AS STRING), 3, '0') || '-' || CAST(k % 10 AS STRING) AS rg,
  'Rua ' || {_pick("Ipê|Carnaúba|Oiticica|Juazeiro", "k")} || ' ' || CAST(k % 900 + 10 AS STRING) AS address,
  CAST(10000 + k % 80000 AS STRING) AS oab, 'Ag ' || CAST(1000 + k % 9000 AS STRING) || ' CC ' || CAST(10000 + k % 80000 AS STRING) || '-' || CAST(k % 10 AS STRING) AS account
FROM ({VALUES_SQL}) vals
"""
_MORE_PIECES = " UNION ALL ".join(f"SELECT k AS doc_id, case_id, {i} AS pos, '{t}' AS type, {sql} AS part FROM ({_MORE_VALUES}) g{i}" for i, t, sql in _MORE)
_MORE_DOCS = f"SELECT k AS doc_id, case_id, {' || '.join(sql for _, _, sql in _MORE)} AS text FROM ({_MORE_VALUES}) g"
_MORE_TRUTH = TRUTH_SQL.replace(PIECES_SQL, _MORE_PIECES)


def _run(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """The rows of ``sql``; with ``spread`` the customers' keys are dealt over tasks before texts are made of them."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(sql.replace('"end"', "`end`"), customer=dealt(customer.select("c_custkey"), "c_custkey") if spread else customer)


def legal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, case_id, text: one document per customer; five documents to a case."""
    return _run(spark, sf_dir, DOCS_SQL, spread=True)


def legal_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TRUTH_SQL)


def more_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the second layout."""
    return _run(spark, sf_dir, _MORE_DOCS, spread=True)


def legal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _FORMATTED)


def for_sql(sql: str) -> str:
    """The same text for an engine that has the tables as views."""
    return sql.replace("{customer}", "customer")


DOCS, TRUTH, VALUES = for_sql(DOCS_SQL), for_sql(TRUTH_SQL), for_sql(_FORMATTED)
MORE_PIECES, MORE_TRUTH = for_sql(_MORE_PIECES), for_sql(_MORE_TRUTH)
