import random
import re

import pytest
from pyspark.sql import functions as F

from brisa.functions import scalars, words
from brisa.functions import standardize as st
from brisa.functions.normalize import fold_ascii, normalize, normalize_text
from brisa.functions.sql import register
from brisa.lookup import STATES, municipalities
from brisa.rules import Rule, RuleSet, builtin

#: kind: input > output, checked against both back ends
CASES = {
    "logradouro": "r. gen.. glicério > RUA GENERAL GLICERIO;RUA 007 > RUA 07;AL 101 > ALAMEDA 101;AVENIDA VER > AVENIDA VER;1111 > ",
    "bairro": "NS aparecida > NOSSA SENHORA APARECIDA;ZONA R > ZONAL RURAL;jd. américa > JARDIM AMERICA",
    "complemento": "QD1 LT2 CS3 > QUADRA 1 LOTE 2 CASA 3;RUA L 5 LOTE 45 > RUA L 5 LOTE 45;S/L 205 > S/L 205;BLA > BLOCO ",
    "tipo_logradouro": "1234 > ;R > RUA;PÇA > PRACA;outros > ",
    "numero": "0210 > 210;1.028 > 1028;sn > S/N; > S/N;ASNO > AS/N;--- > S/N",
    "estado": "021 > MA;maranhao > MA; 21 > MA;me > ; > ",
    "estado_nome": "ma > MARANHAO;São  Paulo > SAO PAULO",
    "estado_codigo": "rj > 33",
    "municipio": "moji mirim > MOGI MIRIM;Nova York > NOVA YORK",
    "cep": "22290-140 > 22290-140;- > 00000-000;a22 > ;123456789 > ",
    "cep_leniente": "a2229014x > 02229-014; > ;22.290-140 99 > 22290-140",
    "metaphone": "Schmidt > SXMIDT;123 Maria > \x20MARIA;carro > KARO;maçã > MASA",
}


@pytest.mark.parametrize("kind", CASES)
def test_cases(spark, kind):
    pairs = [x.split(" > ") if not x.endswith(" > ") else [x[:-3], ""] for x in CASES[kind].split(";")]
    df = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, None)], "a string, b string")
    got = df.select("a", "b", st.by_kind(kind)(F.col("a")).alias("c")).collect()
    assert [(r.a, r.c) for r in got] == [(r.a, r.b) for r in got]
    for a, b in pairs:
        assert scalars.SCALARS[kind](a) == b


def test_unknown_kind():
    with pytest.raises(ValueError):
        st.by_kind("rua")


def test_normalize(spark):
    some = [" a ", "RUA 😀", "½", "ß ı Ø", "№ 5", "…", "ª", "x ", " é\t", "", "ǆ𝐀Ａ", None, "a\nb", "ﬁm"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in some], "v string").select(normalize(F.col("v")).alias("x")).collect()]
    assert got == [None if x is None else normalize_text(x) for x in some]
    assert (normalize_text("½"), normalize_text("RUA 😀"), normalize_text("№"), fold_ascii(" é")) == ("12", "RUA ", "NO", " E")


def test_rules_fire_once_in_order():
    s = RuleSet().add("B", "C").add("A", "B")
    assert s.apply("ab") == "BC"
    assert RuleSet().add("X", "$1x").rules[0].replacement == "$1X"
    guarded = RuleSet().add("R", "RUA", "AV")
    assert (guarded.apply("R 1"), guarded.apply("R AV")) == ("RUA 1", "R AV")


def test_building_and_export(spark):
    s = RuleSet().add_pairs([["ESC", None, "ESCOLA"], ["X"], [], [None], ["R", "RUA", "AV"]])
    assert s.pairs() == [("ESC", "ESCOLA", None), ("X", "", None), ("R", "RUA", "AV")]
    assert RuleSet().add_vectors(*s.vectors()) == s
    with pytest.raises(ValueError):
        s.add_vectors(["A"], [])
    assert [tuple(r) for r in s.to_df(spark).collect()] == [(k, *p) for k, p in enumerate(s.pairs())]
    assert builtin("number").add("Z", "z").rules[-1] == Rule("Z", "Z")
    assert [len(builtin(n).rules) for n in ("street", "neighbourhood", "complement", "street_type", "number", "state", "municipality", "phonetic")] == [190, 115, 176, 84, 7, 2, 28, 21]


@pytest.mark.parametrize("name", ["neighbourhood", "street_type", "complement"])
def test_back_ends_agree(spark, name):
    rng, rules = random.Random(5), builtin(name)
    bits = sorted({x for p, to, _ in rules.pairs() for x in re.findall(r"[A-Z0-9/.-]{1,9}", f"{p} {to}")})
    rows = ["".join(rng.choice(bits) + rng.choice(["", " ", ".", ", "]) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    rows += ["", " ", "ção", "S/N. RES", "TV L-4"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    native = [r.x for r in df.select(rules.as_column(F.col("v")).alias("x")).collect()]
    arrow = [r.x for r in df.select(rules.as_arrow_udf()(F.col("v")).alias("x")).collect()]
    assert native == arrow == [rules.apply(r) for r in rows]


def test_house_numbers(spark):
    df = spark.createDataFrame([("0210",), ("S/N",), ("0",), ("+5",), ("4294967295",), ("4294967296",), ("12a",), (None,), ("9" * 60,)], "v string")
    assert [r.x for r in df.select(st.number_to_int(F.col("v")).alias("x")).collect()] == [210, None, None, 5, 4294967295, None, None, None, None]
    df = spark.createDataFrame([(210.0,), (1.9,), (0.0,), (-11.0,), (0.5,), (float("nan"),), (1e20,), (None,), (float("inf"),)], "v double")
    assert [r.x for r in df.select(st.number_to_string(F.col("v")).alias("x")).collect()] == ["210", "1", "S/N", "S/N", "0", "NaN", "1" + "0" * 20, None, "inf"]


def test_postcodes(spark):
    df = spark.createDataFrame([("22290140", 22290140), ("  ", 1), ("a", 99999999), ("123456789", -123), (None, None), ("٣", 0)], "v string, n int")
    rows = df.select(st.postcode_strict(F.col("v")).alias("s"), st.postcode_numeric(F.col("n")).alias("n")).collect()
    assert [r.s and (r.s.value, r.s.error is None) for r in rows] == [("22290-140", True), ("", True), (None, False), (None, False), None, (None, False)]
    assert [r.n and (r.n.value, r.n.error is None) for r in rows] == [("22290-140", True), ("00000-001", True), (None, False), ("-0000-123", True), None, ("00000-000", True)]


def test_words(spark):
    some = {0: "ZERO", 100: "CEM", 42: "QUARENTA E DOIS", -1500: "MENOS MIL E QUINHENTOS", 2001000: "DOIS MILHOES E MIL", -1000: "MENOS E MIL", 1_000_001: "UM MILHAO E UM", 1110: "MIL CENTO E DEZ", -7: "MENOS SETE"}
    assert {k: words.words_of(k) for k in some} == some
    rng = random.Random(2)
    ns = [*some, 2**31 - 1, -(2**31), *(rng.randint(-(2**31), 2**31 - 1) for _ in range(200)), *(rng.randint(0, 9) * 10 ** rng.randint(0, 8) for _ in range(50))]
    df = spark.createDataFrame([(n,) for n in ns] + [(None,)], "n int")
    assert [r.x for r in df.select(words.number_to_words(F.col("n")).alias("x")).collect()] == [*map(words.words_of, ns), None]
    assert words.digits_in_text("Rua 007, 99999999999 -2.2") == "Rua SETE, 99999999999 -DOIS.DOIS"
    assert [words.roman_in_text(x) for x in ("DI", "MÃO X", "MMMMM", "IIII")] == ["QUINHENTOS E UM", "MÃO DEZ", "CINCO MIL", "IIII"]
    romans = ["IX", "xlII", "MCMXC", "", "abc", "IIII", "XIVV"]
    df = spark.createDataFrame([(r,) for r in romans], "v string")
    assert [r.x for r in df.select(words.roman_to_int(F.col("v")).alias("x")).collect()] == [words.roman_value(r) for r in romans]


def test_municipalities(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cod_ibge,municipio,uf\n3304557,Rio de Janeiro,RJ\n3550308,São Paulo,SP\n")
    table = municipalities(spark, str(tmp_path / "m.csv"))
    df = spark.createDataFrame([("003304557",), ("355030",), ("moji mirim",), (None,)], "v string")
    assert {r.v: r.x for r in st.with_municipality(df, "v", "x", table).collect()} == {"003304557": "RIO DE JANEIRO", "355030": "SAO PAULO", "moji mirim": "MOGI MIRIM", None: None}
    assert len(STATES) == 27


def test_address_record(spark):
    df = spark.range(1).select(st.address(logradouro=F.lit(" a "), numero=F.lit(""), localidade=F.lit("b")).alias("a"))
    r = df.select(st.format_address(F.col("a")).alias("f"), st.standardize_address(F.col("a")).alias("s")).first()
    assert r.f == "a, , b" and tuple(r.s) == ("A", "S/N", None, "B")


def test_sql(spark):
    assert "padronizar_logradouro" in register(spark)
    assert tuple(spark.sql("SELECT padronizar_logradouro('r. azul'), padronizar_cep('22290140'), padronizar_estado(NULL), numeros_por_extenso('20')").first()) == ("RUA AZUL", "22290-140", None, "VINTE")


def test_command_line(capsys):
    from brisa.__main__ import main

    assert main(["logr", "av", "brasil"]) == 0 and capsys.readouterr().out == "AVENIDA BRASIL\n"
    assert main(["?"]) == 2
