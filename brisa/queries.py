"""Driver queries of the address operators, and the same in DuckDB SQL.

The driver's tables hold no addresses, so inputs are put together from their columns by SQL that both
engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.functions import standardize as st
from brisa.functions import words
from brisa.functions.normalize import normalize
from brisa.lookup import STATES
from brisa.operators import split
from brisa.plans import prepare, tables
from brisa.rules import RuleSet, builtin
from brisa.session import ensure_importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _pick(column: str, *values: str) -> str:
    """SQL for one of the values, by the column's remainder."""
    return f"split_part('{'|'.join(values)}', '|', CAST(1 + {column} % {len(values)} AS INT))"


def _spaced(*parts: str) -> str:
    return "concat(" + ", ' ', ".join(parts) + ")"


def _of(table: str, columns: list[str]) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)

    return read


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NORMAL = r"upper(regexp_replace(strip_accents(trim(x)), '[^\x00-\x7F]', '', 'g'))"


def chain_sql(source: str, rules: RuleSet, first: str = NORMAL) -> str:
    """The rules as nested subqueries over ``source`` (columns id, raw, x): one step each."""
    sql = f"SELECT id, raw, {first} AS x FROM ({source})"
    for r in rules.rules:
        to = r.replacement.replace("${", "$").replace("}", "")
        for k in range(9, 0, -1):
            to = to.replace(f"${k}", f"\\{k}")
        pattern = r.pattern.replace(r"\u00BA", r"\x{BA}")
        step = f"regexp_replace(x, {_q(pattern)}, {_q(to)}, 'g')"
        if r.guard:
            step = f"CASE WHEN regexp_matches(x, {_q(r.guard)}) THEN x ELSE {step} END"
        sql = f"SELECT id, raw, {step} AS x FROM ({sql})"
    return sql


def _inputs(table: str, key: str, text: str) -> tuple[Query, str]:
    return _of(table, [f"{key} AS id", f"{text} AS raw"]), f"SELECT {key} AS id, {text} AS raw, {text} AS x FROM {table}"


STREET = _inputs(
    "lineitem",
    "l_orderkey * 10 + l_linenumber",
    _spaced(_pick("l_orderkey", "r.", "Av", "rod", "AL.", "tv", "Pça", "estr.", "R", "BC", "Lad.", "vl", "Cond."), _pick("l_partkey", "gen.", "dr", "Profa", "N. Sra. das Graças", "sta", "cel.", "mal.", "pe", "D. Pedro", "sgto", "S/N", "BR 101", "eng.", "ten. cel"), _pick("l_suppkey", "Glicério", "15 de nov", "João da Silva", "7 de set.", "das Flores", "São Paulo", "Brasil", "km. 007"), "CAST(l_linenumber AS VARCHAR(9))"),
)
STREET_TYPE = _inputs("orders", "o_orderkey", _spaced(_pick("o_orderkey", "1a", "", "AC.", "2", "-"), _pick("o_custkey", "r", "av.", "TRV", "pca", "BECO", "lot", "cond.", "jd", "ESTR", "outros", "rod", "vl", "QD", "fazenda", "Sitio")))
NEIGHBOURHOOD = _inputs("orders", "o_orderkey", _spaced(_pick("o_orderkey", "jd.", "Vl", "pq", "cj", "Res.", "Z. R", "cid", "N Sra de", "sto", "st. ind", "Lot.", "chac"), _pick("o_custkey", "América", "Aparecida", "Antônio", "das Flores", "7 de set", "pres. Vargas", "prof. José", "D. Pedro II")))
COMPLEMENT = _inputs("lineitem", "l_orderkey * 10 + l_linenumber", _spaced(_pick("l_orderkey", "ap", "apto.", "QD1LT2CS3", "bl", "Qd. 5", "lt", "cs 3", "fundos", "S/L 205", "RUA L 5", "TV L-4", "and", "cob.", "BLA", "FDS"), "CAST(l_partkey % 300 AS VARCHAR(9))", _pick("l_suppkey", "bl. B", "lote 45", "edif. Sol", "s/n rural", "n. res. Sul", "prox. à BR", "cond", "Q 7")))
NUMBER = _inputs("orders", "o_orderkey", "CASE o_orderkey % 7 WHEN 0 THEN 'sn' WHEN 1 THEN '' WHEN 2 THEN ' S.N. ' WHEN 3 THEN concat('00', CAST(o_custkey AS VARCHAR(20))) WHEN 4 THEN concat(CAST(1 + o_custkey % 9 AS VARCHAR(20)), '.', CAST(100 + o_custkey % 900 AS VARCHAR(20))) WHEN 5 THEN '---' ELSE concat(' ', CAST(o_orderkey AS VARCHAR(20)), '  A') END")
PHONETIC = _inputs("customer", "c_custkey", _spaced("c_name", _pick("c_custkey", "Schmidt", "Carvalho", "Felipe Chagas", "Quintanilha", "Wagner Nunes", "Hélio Gonçalves", "Rosccia Zezé")))
TOWN = _inputs("orders", "o_orderkey", _pick("o_orderkey", "Moji Mirim", "  brasopolis ", "Santana do Livramento", "itapage", "Seridó", "São Paulo", "Biritiba-Mirim", "GRAO PARA"))
STATE = _inputs("customer", "c_custkey", _pick("c_custkey", "ma", " 021", "Maranhão", "SP", "35 ", "xx", "", "rio grande  do norte", "DF"))
POSTCODE = _inputs("orders", "o_orderkey", "CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'a22' WHEN 2 THEN '  ' WHEN 3 THEN '-' WHEN 4 THEN '22.290-140' WHEN 5 THEN '1234567890' ELSE CAST(o_orderkey * 37 AS VARCHAR(20)) END")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _column(inputs: tuple[Query, str], f, out: str = "value") -> Query:
    return lambda spark, sf_dir: inputs[0](spark, sf_dir).select("id", "raw", f(F.col("raw")).alias(out))


for _name, _input, _rules, _f in (
    ("street", STREET, "street", st.street),
    ("street_type", STREET_TYPE, "street_type", st.street_type),
    ("neighbourhood", NEIGHBOURHOOD, "neighbourhood", st.neighbourhood),
    ("complement", COMPLEMENT, "complement", st.complement),
    ("number", NUMBER, "number", st.number),
    ("municipality", TOWN, "municipality", st.municipality_text),
):
    _add(_name, _column(_input, _f), f"SELECT id, raw, x AS value FROM ({chain_sql(_input[1], builtin(_rules))})")

_add("street_native", lambda spark, sf_dir: STREET_TYPE[0](spark, sf_dir).select("id", "raw", builtin("street_type").as_column(F.col("raw")).alias("value")), ORACLE_SQL["street_type"])
_add("normalize_text", lambda spark, sf_dir: _of("documents", ["doc_id", "text"])(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("value")), f"SELECT doc_id, {NORMAL.replace('trim(x)', 'trim(text)')} AS value FROM documents")
_number = f"SELECT id, x FROM ({chain_sql(NUMBER[1], builtin('number'))})"
_add("number_int", lambda spark, sf_dir: NUMBER[0](spark, sf_dir).select("id", st.number_to_int(F.col("raw")).alias("value")), f"SELECT id, CASE WHEN regexp_full_match(x, '\\+?[0-9]+') AND CAST(x AS HUGEINT) BETWEEN 1 AND 4294967295 THEN CAST(x AS BIGINT) END AS value FROM ({_number})")
_add("number_string", lambda spark, sf_dir: _of("customer", ["c_custkey", "c_acctbal"])(spark, sf_dir).select("c_custkey", st.number_to_string(F.col("c_acctbal")).alias("value")), "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'S/N' ELSE CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) END AS value FROM customer")


def _postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = POSTCODE[0](spark, sf_dir)
    strict, numeric = st.postcode_strict(F.col("raw")), st.postcode_numeric(F.col("id") * 7919)
    return df.select("id", "raw", strict["value"].alias("strict"), strict["error"].isNotNull().alias("is_error"), st.postcode(F.col("raw")).alias("plain"), st.postcode_lenient(F.col("raw")).alias("lenient"), numeric["value"].alias("numeric"))


_add(
    "postcode",
    _postcodes,
    f"""WITH s AS ({POSTCODE[1]}), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS dig FROM s),
e AS (SELECT *, regexp_matches(raw, '[a-z]') OR length(dig) > 8 AS is_error, lpad(CAST(id * 7919 AS VARCHAR), 8, '0') AS num, lpad(left(dig, 8), 8, '0') AS len FROM d),
f AS (SELECT *, CASE WHEN is_error THEN NULL WHEN trim(raw) = '' THEN '' ELSE concat(left(lpad(dig, 8, '0'), 5), '-', right(lpad(dig, 8, '0'), 3)) END AS strict FROM e)
SELECT id, raw, strict, is_error, coalesce(strict, '') AS plain, CASE WHEN raw = '' THEN '' ELSE concat(left(len, 5), '-', right(len, 3)) END AS lenient,
CASE WHEN id * 7919 < 99999999 THEN concat(left(num, 5), '-', right(num, 3)) END AS numeric FROM f""",
)
_states = ", ".join(f"({_q(k)}, {_q(c)}, {_q(a)}, {_q(n)})" for c, a, n in STATES for k in (c, a, n))
_add(
    "state",
    lambda spark, sf_dir: STATE[0](spark, sf_dir).select("id", "raw", st.state_code(F.col("raw")).alias("code"), st.state_abbreviation(F.col("raw")).alias("abbreviation"), st.state_name(F.col("raw")).alias("name")),
    f"SELECT s.id, s.raw, coalesce(t.code, '') AS code, coalesce(t.ab, '') AS abbreviation, coalesce(t.name, '') AS name FROM ({chain_sql(STATE[1], builtin('state'))}) s LEFT JOIN (VALUES {_states}) t(key, code, ab, name) ON s.x = t.key",
)
_dedup = "x"
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ13 ":
    _dedup = f"regexp_replace({_dedup}, '{_c}{_c}+', '{_c}', 'g')"
_add("phonetic", _column(PHONETIC, st.phonetic), f"SELECT id, raw, {_dedup} AS value FROM ({chain_sql(PHONETIC[1], builtin('phonetic'), NORMAL.replace('trim(x)', 'trim(translate(x, ' + _q('Çç') + ', ' + _q('Ss') + '))'))})")

_small = "[" + ", ".join(map(_q, words.SMALL)) + "]"
_add(
    "number_words",
    lambda spark, sf_dir: _of("lineitem", ["l_orderkey * 10 + l_linenumber AS id", "CAST((l_orderkey * 7919 + l_linenumber) % 1000000 * (1 - 2 * (l_linenumber % 2)) AS INT) AS n"])(spark, sf_dir).select("id", "n", words.number_to_words(F.col("n")).alias("value")),
    f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST((l_orderkey * 7919 + l_linenumber) % 1000000 * (1 - 2 * (l_linenumber % 2)) AS INT) AS n FROM lineitem),
w AS (SELECT *, {_small} AS t, abs(n) // 1000 AS k, abs(n) % 1000 AS r FROM s)
SELECT id, n, concat(CASE WHEN n < 0 THEN 'MENOS' ELSE '' END, CASE WHEN k = 0 AND n < 0 THEN ' ' ELSE '' END,
 CASE WHEN k > 0 THEN concat(CASE WHEN n >= 0 THEN '' WHEN r = 0 THEN ' E ' ELSE ' ' END, CASE WHEN k = 1 THEN 'MIL' ELSE concat(t[k + 1], ' MIL') END) ELSE '' END,
 CASE WHEN k = 0 THEN t[r + 1] WHEN r = 0 THEN '' WHEN r < 100 OR r % 100 = 0 THEN concat(' E ', t[r + 1]) ELSE concat(' ', t[r + 1]) END) AS value FROM w""",
)
_add("digits_words", lambda spark, sf_dir: _of("orders", ["o_orderkey AS id", "concat('Rua ', CAST(o_orderkey % 1000 AS VARCHAR(9)), ' nº') AS raw"])(spark, sf_dir).select("id", words.digits_to_words(F.col("raw")).alias("value")), f"SELECT o_orderkey AS id, concat('Rua ', ({_small})[o_orderkey % 1000 + 1], ' nº') AS value FROM orders")
_ROMAN = ("I", "iv", "IX", "XIV", "xl", "XC", "CD", "CM", "MCMXC", "MMMCMXCIX", "IIII", "MÃO")
_VALUE = (1, 4, 9, 14, 40, 90, 400, 900, 1990, 3999, 4, 1000)
_add(
    "roman",
    lambda spark, sf_dir: _of("part", ["p_partkey AS id", f"{_pick('p_partkey', *_ROMAN)} AS raw"])(spark, sf_dir).select("id", "raw", words.roman_to_int(F.col("raw")).alias("value"), words.roman_to_words(F.concat(F.lit("Rua "), F.col("raw"))).alias("text")),
    f"SELECT p_partkey AS id, {_pick('p_partkey', *_ROMAN)} AS raw, [{', '.join(map(str, _VALUE))}][p_partkey % {len(_VALUE)} + 1] AS value, concat('Rua ', [{', '.join(_q(words.words_of(v)) if r not in ('IIII', 'MÃO') else _q(r) for r, v in zip(_ROMAN, _VALUE))}][p_partkey % {len(_VALUE)} + 1]) AS text FROM part",
)
_record = {"logradouro": "concat(' ', c_name, ' ')", "numero": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR(9)) END", "complemento": "CASE WHEN c_custkey % 2 = 0 THEN 'ap' END", "localidade": "n_name"}


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    c = tables.spread(c.select("c_custkey", "c_name", "c_nationkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", st.address(**{k: F.expr(v) for k, v in _record.items()}).alias("a"))


_add("address_format", lambda spark, sf_dir: _addresses(spark, sf_dir).select("c_custkey", st.format_address(F.col("a")).alias("value")), f"SELECT c_custkey, concat_ws(', ', {', '.join(f'trim({v})' for v in _record.values())}) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
_parts = {
    f: chain_sql(f"SELECT c_custkey AS id, {v} AS raw, {v} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey", builtin(rules))
    for (f, v), rules in zip(_record.items(), ("street", "number", "complement", "neighbourhood"))
}
_add(
    "address_standardize",
    lambda spark, sf_dir: _addresses(spark, sf_dir).select("c_custkey", st.standardize_address(F.col("a")).alias("a")).select("c_custkey", "a.*"),
    "SELECT logradouro.id AS c_custkey, " + ", ".join(f"{f}.x AS {f}" for f in _parts) + " FROM "
    + " JOIN ".join(f"({sql}) {f}" + (" ON logradouro.id = " + f + ".id" if k else "") for k, (f, sql) in enumerate(_parts.items())),
)
_add("standardize_table", lambda spark, sf_dir: tables.standardize_table(STREET_TYPE[0](spark, sf_dir), ["tipo_logr:raw:value"], keep=["id", "raw"]), ORACLE_SQL["street_type"])
_add("standardize_table_distinct", lambda spark, sf_dir: tables.standardize_table(STREET_TYPE[0](spark, sf_dir), ["tipo_logr:raw:value"], keep=["id", "raw"], distinct_first=True), ORACLE_SQL["street_type"])
_add("diff_table", lambda spark, sf_dir: tables.diff_table(TOWN[0](spark, sf_dir).withColumn("want", F.upper("raw")), "municipio", "raw", "want"), f"SELECT DISTINCT raw, upper(raw) AS expected, x AS actual FROM ({chain_sql(TOWN[1], builtin('municipality'))}) WHERE x <> upper(raw)")
_add("snapshot_compare", lambda spark, sf_dir: tables.snapshot_compare(TOWN[0](spark, sf_dir).select("raw"), TOWN[0](spark, sf_dir).select("raw", F.upper("raw").alias("value")).distinct(), "municipio"), f"SELECT DISTINCT raw, upper(raw) AS expected, x AS actual FROM ({chain_sql(TOWN[1], builtin('municipality'))}) WHERE x <> upper(raw)")


def _towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1100000).cast("string").alias("key"), F.col("n_name").alias("name"))


_add(
    "municipality_lookup",
    lambda spark, sf_dir: st.with_municipality(_of("customer", ["c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(1100000 + c_nationkey AS VARCHAR(9)) END AS town"])(spark, sf_dir), "town", "name", _towns(spark, sf_dir)).select("c_custkey", "name"),
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
_add(
    "union_sources",
    lambda spark, sf_dir: prepare.union_sources({t: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(f"{p}_name"), F.lit(None).cast("string").alias("n"), F.lit("").alias("c"), F.col(f"{p}_nationkey").cast("string").alias("l"), F.lit("0").alias("z"), F.lit("x").alias("m"), F.lit("SP").alias("u")) for t, p in (("customer", "c"), ("supplier", "s"))}),
    " UNION ".join(f"SELECT {p}_name AS logradouro, CAST(NULL AS VARCHAR) AS numero, '' AS complemento, CAST({p}_nationkey AS VARCHAR) AS localidade, '0' AS cep, 'x' AS municipio, 'SP' AS uf, '{t}' AS origem FROM {t}" for t, p in (("customer", "c"), ("supplier", "s"))),
)
_TOWN = "SELECT concat(CAST(110000 + n_nationkey AS VARCHAR(9)), '0') AS cod_ibge, n_name AS municipio, 'SP' AS uf FROM nation WHERE n_nationkey % 2 = 0"


def _with_towns(f, columns: dict[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*[f"{v} AS `{k}`" for k, v in columns.items()])
        towns = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0").selectExpr("concat(CAST(110000 + n_nationkey AS VARCHAR(9)), '0') AS cod_ibge", "n_name AS municipio", "'SP' AS uf")
        return f(rows, towns)

    return run


_CNES = {"no_logradouro": "c_name", "nu_endereco": "c_custkey", "no_bairro": "c_mktsegment", "co_cep": "'1'", "co_ibge": "CAST(110000 + c_nationkey AS VARCHAR(9))"}
_add("prepare_left_join", _with_towns(prepare.prepare_cnes, _CNES), f"SELECT c_name AS logradouro, CAST(c_custkey AS VARCHAR) AS numero, CAST(NULL AS VARCHAR) AS complemento, c_mktsegment AS localidade, '1' AS cep, t.municipio, t.uf FROM customer LEFT JOIN ({_TOWN}) t ON CAST(110000 + c_nationkey AS VARCHAR) = left(t.cod_ibge, 6)")
_CNEFE = {"nom_tipo_seglogr": "'RUA'", "nom_titulo_seglogr": "CASE WHEN c_custkey % 2 = 0 THEN 'DOM' ELSE '' END", "nom_seglogr": "c_name", "num_adress": "c_custkey", "dsc_modificador": "CASE WHEN c_custkey % 3 = 0 THEN 'A' END", "nom_comp_elem1": "'AP'", "val_comp_elem1": "'  7 '", "nom_comp_elem2": "''", "val_comp_elem2": "'9'", "nom_comp_elem3": "NULL", "val_comp_elem3": "NULL", "nom_comp_elem4": "'X'", "desc_localidade": "c_mktsegment", "cep": "'1'", "code_muni": "concat(CAST(110000 + c_nationkey AS VARCHAR(9)), '0')"}
_add("prepare_inner_join", _with_towns(prepare.prepare_cnefe, _CNEFE), f"SELECT concat_ws(' ', 'RUA', CASE WHEN c_custkey % 2 = 0 THEN 'DOM' END, c_name) AS logradouro, concat_ws(' ', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'A' END) AS numero, 'AP 7 9 X' AS complemento, c_mktsegment AS localidade, '1' AS cep, t.municipio, t.uf FROM customer JOIN ({_TOWN}) t ON concat(CAST(110000 + c_nationkey AS VARCHAR), '0') = t.cod_ibge")
_add(
    "profile",
    lambda spark, sf_dir: prepare.profile(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority"), exact=True),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS n_distinct, 1 - CAST(count({c}) AS DOUBLE) / count(*) AS null_share FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
)
_add("dedupe_sorted", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_mktsegment").distinct().orderBy("c_nationkey", "c_mktsegment").limit(50), "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 1, 2 LIMIT 50")
_DRAW = "CAST('0x' || substr(md5(concat_ws('|', '0', CAST(c_custkey AS VARCHAR))), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"
_customer = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet")
_add("random_split", lambda spark, sf_dir: prepare.random_split(_customer(spark, sf_dir), ["c_custkey"])[0], f"SELECT * FROM customer WHERE {_DRAW} < 0.9")
_add("sample_rows", lambda spark, sf_dir: prepare.sample_rows(_customer(spark, sf_dir), 100, keys=["c_custkey"]), f"SELECT * FROM customer ORDER BY {_DRAW}, c_custkey LIMIT 100")
_add(
    "summarize",
    lambda spark, sf_dir: prepare.summarize(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")).withColumns({"avg": F.round("avg", 3), "std": F.round("std", 3)}),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS n_distinct, 1 - CAST(count({c}) AS DOUBLE) / count(*) AS null_share, "
        + (f"round(avg({c}), 3) AS avg, round(stddev_samp({c}), 3) AS std, " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {q / 100}) AS q{q}" for q in (25, 50, 75)) if c != "o_orderstatus" else ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("avg", "std", "q25", "q50", "q75")))
        + " FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus")
    ),
)


def _prepared(f, columns: dict[str, str]) -> Query:
    return lambda spark, sf_dir: f(_customer(spark, sf_dir).selectExpr(*[f"{v} AS `{k}`" for k, v in columns.items()]))


def _text(*columns: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {n}" for c, n in zip(columns, prepare.COLUMNS)) + " FROM customer"


_odd = "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END"
_p = "cneas_entidade_endereco_"
_add(
    "prepare_cneas",
    _prepared(prepare.prepare_cneas, {f"{_p}logradouro_s": "c_name", f"{_p}numero_s": "c_custkey", f"{_p}complemento_s": _odd, f"{_p}bairro_s": "c_mktsegment", f"{_p}cep_s": "c_nationkey", "cneas_entidade_nome_municipio_s": "concat('T', c_name)", "cneas_entidade_sigla_uf_s": "'SP'"}),
    _text("c_name", "c_custkey", _odd, "c_mktsegment", "c_nationkey", "concat('T', c_name)", "'SP'"),
)
_add(
    "prepare_cno",
    _prepared(prepare.prepare_cno, {"Tipo de logradouro": _odd, "Logradouro": "c_name", "Número do logradouro": "c_custkey", "Complemento": _odd, "Bairro": "c_mktsegment", "CEP": "c_nationkey", "Nome do município": "concat('T', c_name)", "Estado": "'SP'"}),
    _text(f"concat_ws(' ', nullif({_odd}, ''), c_name)", "c_custkey", _odd, "c_mktsegment", "c_nationkey", "concat('T', c_name)", "'SP'"),
)
_add(
    "prepare_school_census",
    _prepared(prepare.prepare_school_census, {"ds_endereco": "c_name", "nu_endereco": _odd, "ds_complemento": _odd, "no_bairro": "c_mktsegment", "co_cep": "c_nationkey", "no_municipio": "concat('T', c_name)", "sg_uf": "CAST(NULL AS STRING)"}),
    _text("c_name", f"coalesce({_odd}, '')", f"coalesce({_odd}, '')", "c_mktsegment", "c_nationkey", "concat('T', c_name)", "''"),
)
_add(
    "prepare_welfare_posts",
    _prepared(prepare.prepare_welfare_posts, {"endereco": "c_name", "numero": "c_custkey", "complemento": _odd, "bairro": "c_mktsegment", "cep": "c_nationkey", "cidade": "concat('T', c_name)", "uf": "'SP'"}),
    _text("c_name", "c_custkey", _odd, "c_mktsegment", "c_nationkey", "concat('T', c_name)", "'SP'"),
)
_add(
    "prepare_cnpj",
    lambda spark, sf_dir: prepare.prepare_cnpj(
        _customer(spark, sf_dir).selectExpr("'RUA' AS tipo_logradouro", "c_name AS logradouro", f"{_odd} AS numero_estab", f"{_odd} AS complemento", "c_mktsegment AS bairro", "c_custkey AS cep", "c_nationkey AS municipio"),
        spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS code", "n_name AS name", "'SP' AS uf"),
    ),
    f"SELECT concat('RUA ', c_name) AS logradouro, coalesce({_odd}, '') AS numero, coalesce({_odd}, '') AS complemento, c_mktsegment AS localidade, CAST(c_custkey AS VARCHAR) AS cep, n_name AS municipio, CASE WHEN n_name IS NOT NULL THEN 'SP' END AS uf FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey",
)
_TAGS = ("'B-LOG'", "'I-LOG'", "CASE c_custkey % 3 WHEN 0 THEN 'B-NUM' WHEN 1 THEN 'O' ELSE 'I-LOG' END", "'B-COM'", "'I-NUM'", "'B-LOC'", "'B-COM'")
_TOKENS = ("'RUA'", "c_name", "CAST(c_custkey AS STRING)", "'AP'", "CAST(c_nationkey AS STRING)", "c_mktsegment", "'LATER'")
_add(
    "assemble_fields",
    lambda spark, sf_dir: _of("customer", ["c_custkey", f"array({', '.join(_TOKENS)}) AS tokens", f"array({', '.join(_TAGS)}) AS tags"])(spark, sf_dir).select("c_custkey", split.assemble_fields("tokens", "tags").alias("a")).select("c_custkey", "a.*"),
    "SELECT c_custkey, concat('RUA ', c_name, CASE WHEN c_custkey % 3 = 2 THEN concat(' ', c_custkey) ELSE '' END) AS logradouro, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS numero, concat('AP ', c_nationkey) AS complemento, c_mktsegment AS localidade FROM customer",
)
_add("tokenize", lambda spark, sf_dir: STREET[0](spark, sf_dir).select("id", F.array_join(split.tokenize(F.col("raw")), "|").alias("tokens")), f"SELECT id, array_to_string(regexp_extract_all(raw, '\\d+|[\\pL\\pM\\pN_]+|[^\\s\\pL\\pM\\pN_]'), '|') AS tokens FROM ({STREET[1]})")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = _addresses(spark, sf_dir).select("c_custkey", F.struct(F.col("a.logradouro"), F.col("a.numero"), F.col("a.complemento"), F.col("a.localidade").alias("bairro"), F.lit("lugar").alias("municipio"), F.lit("SP").alias("uf"), F.lit("01310100").alias("cep")).alias("r")).select("c_custkey", "r.*")
    noisy = split.add_noise(record, "c_custkey")
    return noisy.select("c_custkey", split.label_address(F.struct(*split.LABELS, "formato", "separador")).alias("l")).select("c_custkey", "l.tokens", "l.tags")


_add("labelled_rows", _tagged)
_add("features", lambda spark, sf_dir: _tagged(spark, sf_dir).select("c_custkey", split.features_of("tokens").alias("features")))
_add("assemble", lambda spark, sf_dir: _tagged(spark, sf_dir).select("c_custkey", split.assemble_fields("tokens", "tags").alias("a")).select("c_custkey", "a.*"))
_GUESS = "CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END"
_add(
    "sequence_accuracy",
    lambda spark, sf_dir: split.sequence_accuracy(_of("orders", ["array(o_orderstatus, 'a') AS tags", f"array({_GUESS}, 'a') AS predicted"])(spark, sf_dir)),
    """SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS sequence_accuracy, avg(CASE WHEN ok THEN 1.0 ELSE 0.5 END) AS mean_token_accuracy
FROM (SELECT o_orderkey % 5 <> 0 OR o_orderstatus = 'F' AS ok FROM orders)""",
)
_MODEL = split.Model(sorted(["B-LOG", "I-LOG", "B-NUM", "O"]), {"0:is_alpha": {"I-LOG": 1.0}, "BOS": {"B-LOG": 2.0}, "0:is_digit": {"B-NUM": 1.0}, "0:is_punct": {"O": 1.0}})
_add(
    "model_round_trip",
    lambda spark, sf_dir: split.Model.from_df(_MODEL.to_df(spark)).to_df(spark),
    "SELECT * FROM (VALUES " + ", ".join([f"('tag', '', {_q(t)}, CAST({k} AS DOUBLE))" for k, t in enumerate(_MODEL.tags)] + [f"('state', {_q(f)}, {_q(t)}, CAST({w} AS DOUBLE))" for f, ts in _MODEL.states.items() for t, w in ts.items()]) + ") t(kind, source, tag, weight)",
)
_add("split_address", lambda spark, sf_dir: tables.split_address_table(STREET[0](spark, sf_dir).withColumnRenamed("raw", "DscEndereco"), _MODEL))
_pairs = lambda spark, sf_dir: _of("orders", ["o_orderpriority AS token", "o_orderstatus AS gold", f"{_GUESS} AS guess"])(spark, sf_dir)
_add("top_errors", lambda spark, sf_dir: split.top_errors(_pairs(spark, sf_dir), ("token", "gold")), f"SELECT o_orderpriority AS token, o_orderstatus AS gold, count(*) AS n FROM orders WHERE o_orderstatus <> {_GUESS} GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
_add(
    "label_report",
    lambda spark, sf_dir: split.label_report(_pairs(spark, sf_dir)),
    f"""WITH p AS (SELECT o_orderstatus AS gold, {_GUESS} AS guess FROM orders),
g AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = guess) AS hits FROM p GROUP BY 1), c AS (SELECT guess AS label, count(*) AS claimed FROM p GROUP BY 1)
SELECT label, hits / CAST(claimed AS DOUBLE) AS precision, hits / CAST(support AS DOUBLE) AS recall, 2 * hits / CAST(claimed + support AS DOUBLE) AS f1, support FROM g FULL JOIN c USING (label)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street names of all lineitem rows, standardized."""
    return QUERIES["street"](spark, sf_dir)
