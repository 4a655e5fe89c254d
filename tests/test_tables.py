import pytest
from pyspark.sql import functions as F

from brisa.operators import split
from brisa.plans import prepare, tables
from brisa.sources import files
from brisa.streaming.jobs import standardize_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_standardize_table(spark):
    df = spark.createDataFrame([("r. azul", 12.7, "x"), ("r. azul", None, "y")], "rua string, n double, k string")
    for distinct in (False, True):
        out = tables.standardize_table(df, ["logr:rua:rua_padr", "num:n:n"], keep=["k", "n"], distinct_first=distinct)
        assert out.columns == ["rua_padr", "n", "k"] and rows(out) == [("RUA AZUL", "12", "x"), ("RUA AZUL", None, "y")]
    assert tables.standardize_table(df, ["estado:rua:e"], keep_all=True, limit=1).count() == 1
    for bad in ("logr:rua", "foo:a:b"):
        with pytest.raises(ValueError):
            tables.parse_spec(bad)


def test_differences(spark):
    df = spark.createDataFrame([("r a", "RUA A"), ("r b", "RUA C"), ("r b", "RUA C"), (None, "X")], "logradouro string, logradouro_padr string")
    assert rows(tables.diff_table(df, "logr")) == [("r b", "RUA C", "RUA B")]
    v = df.select("logradouro").where("logradouro IS NOT NULL")
    golden = tables.snapshot(v, "logr")
    assert tables.snapshot_compare(v, golden, "logr").isEmpty()
    assert rows(tables.snapshot_compare(v, golden.withColumn("value", F.lit("?")), "logr")) == [("r a", "?", "RUA A"), ("r b", "?", "RUA B")]
    raw = spark.createDataFrame([(1, "r a"), (2, "av b")], "line int, value string")
    assert rows(tables.line_compare(raw, spark.createDataFrame([(1, "RUA A"), (2, "B")], "line int, value string"), "logr")) == [(2, "av b", "B", "AVENIDA B")]
    with pytest.raises(ValueError):
        tables.line_compare(raw, raw.limit(1), "logr")


def test_prepare(spark):
    towns = spark.createDataFrame([("3304557", "Rio", "RJ")], "cod_ibge string, municipio string, uf string")
    cnes = spark.createDataFrame([("R A", "1", "B", "20000", "330455"), ("R Z", "2", "C", "1", "0")], "no_logradouro string, nu_endereco string, no_bairro string, co_cep string, co_ibge string")
    out = prepare.prepare_cnes(cnes, towns)
    assert out.columns == list(prepare.COLUMNS)
    assert rows(out) == [("R A", "1", None, "B", "20000", "Rio", "RJ"), ("R Z", "2", None, "C", "1", None, None)]
    names = [f"nom_{x}_seglogr" for x in ("tipo", "titulo")] + ["nom_seglogr", "num_adress", "dsc_modificador", *(f"nom_comp_elem{k}" for k in range(1, 5)), *(f"val_comp_elem{k}" for k in range(1, 4)), "desc_localidade", "cep", "code_muni"]
    cnefe = spark.createDataFrame([("RUA", "", "A", "5", None, "AP", "", None, None, "3", "", None, "B", "2", "3304557")], ", ".join(f"{n} string" for n in names))
    assert rows(prepare.prepare_cnefe(cnefe, towns)) == [("RUA A", "5", "AP 3", "B", "2", "Rio", "RJ")]
    both = prepare.union_sources({"a": out, "b": out.union(out)})
    assert both.count() == 4 and both.columns[-1] == "origem"
    df = spark.range(1000)
    a, b = prepare.random_split(df, ["id"])
    assert a.count() + b.count() == 1000 and 850 < a.count() < 950 and a.intersect(b).isEmpty()
    assert prepare.sample_rows(df, 10).distinct().count() == 10
    p = prepare.profile(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), exact=True)
    assert rows(p) == [("a", "1", "2", 2, 0.0), ("b", "x", "x", 1, 0.5)]


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "l.csv").write_bytes("a;b\nção;1\n".encode("latin-1"))
    assert rows(files.read_csv(spark, str(tmp_path / "l.csv"), "ISO-8859-1", ";")) == [("ção", "1")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "a;b\nção;1\n".encode("latin-1"))
    assert rows(files.read_zipped_csv(spark, str(tmp_path / "z.zip"), ["b", "a", "c"], "latin-1", ";")) == [("1", "ção", None)]
    df = spark.createDataFrame([('q"x, y',), ("b",)], "v string")
    files.write_lines(df, str(tmp_path / "t"))
    assert rows(files.read_lines(spark, str(tmp_path / "t"))) == rows(df)
    files.write_parquet(df, str(tmp_path / "p"))
    assert rows(files.read_parquet(spark, str(tmp_path / "p"))) == rows(df)


def test_golden_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("r a\nav b\nr a\n")
    tables.save_snapshot(spark, str(tmp_path / "in.txt"), str(tmp_path / "golden"), "logr")
    assert tables.check_snapshot(spark, str(tmp_path / "in.txt"), str(tmp_path / "golden"), "logr").isEmpty()
    assert rows(tables.check_snapshot(spark, str(tmp_path / "in.txt"), str(tmp_path / "golden"), "bairro")) != []


def test_stream(spark, tmp_path):
    spark.createDataFrame([("av. a",), ("r b",)], "v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in"))
    standardize_stream(stream, ["logr:v:w", "num:v:n"], str(tmp_path / "out"), str(tmp_path / "cp"), ["v"]).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("AVENIDA A", "AV. A", "av. a"), ("RUA B", "R B", "r b")]


def test_features():
    f = split.features(["Rua", "São", ",", "007"])
    assert f[0] == ["bias", "0_pos", "0:RUA", "0:tam:3", "0:is_alpha", "BOS", "+1:tam:3", "+1:is_digit", "+1:digit_len:1", "tem_pontuacao:+1"]
    assert {"0:SAO", "0:is_alpha"} <= set(f[1]) and {"0:is_punct", "0:,"} <= set(f[2]) and {"EOS", "-1:RUA"} <= set(f[3])
    assert "0:is_unknown" in split.features(["日"])[0] and split.features([]) == []


def test_assembly():
    tokens = "Rua A , 10 fundos x y".split()
    tags = "B-LOG I-LOG O B-NUM B-COM I-LOG I-COM".split()
    assert split.assemble(tokens, tags) == {"logradouro": "Rua A", "numero": "10", "complemento": "fundos x y", "localidade": None}
    assert split.assemble(["a", "b", "c"], ["I-LOG", "B-MUN", "I-MUN"]) == dict.fromkeys(split.TAGS.values())
    assert split.assemble(["a", "b", "c"], ["B-LOG", "B-LOG", "I-LOG"])["logradouro"] == "a c"
    assert split.assemble_all(["a", "b", "c"], ["B-LOG", "B-LOG", "I-LOG"])["LOG"] == ["a", "b c"]


def test_splitting(spark):
    base = [(k, f"RUA {w}", str(k + 10), "", f"JARDIM {w}", "RIO", "RJ", "20000000") for k, w in enumerate("AZUL BRASIL FLORES ROSA SOL LUA MAR CAMPO".split() * 8)]
    df = spark.createDataFrame(base, "id long, logradouro string, numero string, complemento string, bairro string, municipio string, uf string, cep string")
    noisy = split.add_noise(df, "id", {"RUA": ["R"], "JARDIM": ["JD"]}, clean=True)
    assert rows(noisy) == rows(split.add_noise(df, "id", {"RUA": ["R"], "JARDIM": ["JD"]}, clean=True))
    got = noisy.select(split.label_address(F.struct(*split.LABELS, "formato", "separador")).alias("l")).select("l.*")
    sample = [(r.tokens, r.tags) for r in got.collect()]
    assert all(len(a) == len(b) for a, b in sample)
    model = split.train(sample)
    tagged = got.withColumn("predicted", split.tag_tokens(F.col("tokens"), model))
    assert split.sequence_accuracy(tagged).first().mean_token_accuracy > 0.95
    assert split.label_report(split.token_pairs(tagged)).where("f1 > 0.9").count() >= 4
    text = spark.createDataFrame([("RUA AZUL, NUM 12, JARDIM SOL",), (None,)], "DscEndereco string")
    out = tables.split_address_table(text, model).collect()
    assert out[0].logradouro == "RUA AZUL" and "12" in out[0].numero and out[1].numero is None
    assert text.select(split.standardize_raw_address(F.col("DscEndereco"), model).alias("x")).first().x.startswith("RUA AZUL")
    assert model.to_rows()[0][2] >= model.to_rows()[-1][2]
    kinds = split.kinds_with(model)
    r = text.select(*[f(F.col("DscEndereco")).alias(k) for k, f in kinds.items()]).first()
    assert r.completo.startswith("RUA AZUL") and '"logradouro":"RUA AZUL"' in r.separar and "SOL" in r.separar_padronizar
    assert split.timing(text, "DscEndereco", model).first().features_us >= 0
    assert split.tune(sample, (1, 3))[0][1] > 0.9
    wrong = tagged.withColumn("predicted", F.reverse("predicted"))
    assert 0 < split.error_samples(wrong, 3).count() <= 3


def test_tokens(spark):
    df = spark.createDataFrame([("Av. São João, nº12",), ("",), (None,)], "v string")
    assert [r.t for r in df.select(split.tokenize(F.col("v")).alias("t")).collect()] == [["Av", ".", "São", "João", ",", "nº12"], [], None]


def test_queries_match_sql(spark):
    """Every query with SQL, on the smallest tables, in both engines."""
    import glob
    import os

    import duckdb

    from brisa import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    fix = lambda x: round(x, 9) if isinstance(x, float) else x
    for name in ("number", "neighbourhood", "state", "postcode", "phonetic", "roman", "number_words", "union_sources", "diff_table", "label_report", "profile"):
        a = queries.QUERIES[name](spark, folder)
        b = con.sql(queries.ORACLE_SQL[name])
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        order = [b.columns.index(c) for c in cols]
        assert sorted([tuple(map(fix, r)) for r in a.select(cols).collect()], key=str) == sorted([tuple(fix(r[i]) for i in order) for r in b.fetchall()], key=str), name
