"""Models as tables, the splitter in SQL, typed SQL functions, seeded draws, widths of sources."""

import pytest
from pyspark.sql import functions as F

from brisa.functions import sql
from brisa.operators import split
from brisa.plans import prepare

MODEL = split.Model(
    ["B-LOG", "B-NUM", "I-LOG", "O"],
    {"0:is_alpha": {"I-LOG": 1.0}, "BOS": {"B-LOG": 2.0}, "0:is_digit": {"B-NUM": 1.0}, "0:is_punct": {"O": 1.0}},
    {("O", "B-NUM"): 0.25},
)


def test_model_saved_and_loaded(spark, tmp_path):
    MODEL.save(spark, str(tmp_path / "m"))
    assert split.Model.load(spark, str(tmp_path / "m")) == MODEL


def slow_features(tokens, neighbours=split.NEIGHBOURS):
    """Both lists of neighbours made anew for every token."""
    plain, out = [k for k, t in enumerate(tokens) if split._plain(t)], []
    for i in range(len(tokens)):
        found = ["bias", f"{int(i / len(tokens) * 4)}_pos", *split.token_features(tokens[i], "0")]
        found += ["BOS"] * (i == 0) + ["EOS"] * (i == len(tokens) - 1)
        for d in neighbours:
            line, k = [p for p in plain if p > i] if d > 0 else [p for p in reversed(plain) if p < i], abs(d)
            if len(line) < k:
                continue
            at, last = line[k - 1], (line[k - 2] if k > 1 else i)
            mark = f"{'+' if d > 0 else '-'}{k}"
            found += split.token_features(tokens[at], mark)
            if at != i + d and any(map(split.is_mark, tokens[min(at, last) : max(at, last) + 1])):
                found.append(f"tem_pontuacao:{mark}")
        out.append(found)
    return out


@pytest.mark.parametrize("text", ["", "RUA", "R. Gen. Glicério, 137 - ap. 801 / bl. B", ", ; .", "a-b c,d. 12 º º x", "AV. . . BRASIL ,,, 500 SN"])
@pytest.mark.parametrize("neighbours", [split.NEIGHBOURS, (1,), (-3, 3)])
def test_features_in_one_walk(text, neighbours):
    tokens = split.pieces(text)
    assert split.features(tokens, neighbours) == slow_features(tokens, neighbours)


def test_zero_is_no_neighbour():
    with pytest.raises(ValueError):
        split.features(["a"], (0,))


def test_sql_functions(spark):
    sql.register(spark)
    sql.register_splitter(spark, MODEL)
    row = spark.sql("SELECT numero_int('00012') a, numero_int('sn') b, numero_por_extenso(1110) c, romano_para_inteiro('XIV') d, separar_endereco('Rua Azul, 12') e, padronizar_endereco_bruto('r azul, 12') f").first()
    assert (row.a, row.b, row.c, row.d) == (12, None, "MIL CENTO E DEZ", 14)
    assert (row.e.logradouro, row.e.numero, row.e.complemento) == ("Rua Azul", "12", None)
    assert row.f == "RUA AZUL, 12"
    nulls = spark.sql("SELECT numero_por_extenso(n) a, romano_para_inteiro(s) b, numero_int(s) c, padronizar_endereco_bruto(s) d FROM VALUES (CAST(NULL AS INT), CAST(NULL AS STRING)), (7, 'X') t(n, s)").collect()
    assert (nulls[0].a, nulls[0].b, nulls[0].c, nulls[0].d) == (None, None, None, None) and nulls[1].a == "SETE" and nulls[1].b == 10


def test_draws_are_repeatable(spark):
    df = spark.range(5000).withColumn("t", F.lit("x"))
    a, b = prepare.random_split(df, ["id"], 0.9, seed=3)
    assert a.count() + b.count() == 5000 and 4400 < a.count() < 4600 and a.join(b, "id").count() == 0
    first = [r.id for r in prepare.sample_rows(df, 20, keys=["id"]).orderBy("id").collect()]
    assert first == [r.id for r in prepare.sample_rows(df.repartition(7), 20, keys=["id"]).orderBy("id").collect()] and len(set(first)) == 20


def test_sources_of_other_width(spark):
    with pytest.raises(ValueError):
        prepare.union_sources({"a": spark.createDataFrame([tuple("abcdefgh")], ", ".join(f"c{k} string" for k in range(8)))})


def test_abbreviations_are_usable(spark):
    df = spark.createDataFrame([("AVENIDA PRESIDENTE VARGAS",)], "x string")
    assert df.select(split.abbreviate(F.col("x"), split.ABBREVIATIONS)).first()[0] == "AV PRES VARGAS"
    assert all(v and all(v) for v in split.ABBREVIATIONS.values())
