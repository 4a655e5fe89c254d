"""What larger tables bring up: keys beyond 32 bits, work that is done again for every batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brisa import queries
from brisa.functions import standardize as st
from brisa.operators import split
from brisa.plans import prepare, tables


def test_postcodes_of_large_keys(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    keys = [0, 7, 12627, 12628, 271179, 271181, 900_000, 9_000_005, 54_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    df = queries.QUERIES["postcode"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["postcode"])
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())


def test_postcodes_beyond_32_bits(spark):
    df = spark.createDataFrame([(2**31,), (-(2**31) - 1,), (2**62,), (99999998,), (None,)], "n bigint")
    rows = [r.x for r in df.select(st.postcode_numeric(F.col("n")).alias("x")).collect()]
    assert [r and (r.value, r.error is None) for r in rows] == [(None, False), (None, False), (None, False), ("99999-998", True), None]


def _by_steps(df, model):
    """The splitter's steps one by one, features spelled out."""
    rows = [r.x for r in df.select(split.tokenize(F.col("v")).alias("x")).collect()]
    fields = [dict.fromkeys(split.FIELDS) if t is None else split.assemble(t, model.tag(split.features(t))) for t in rows]
    made = df.sparkSession.createDataFrame([tuple(f.values()) for f in fields], split.SPLIT)
    return fields, [tuple(r.a) for r in made.select(st.standardize_address(F.struct(*made.columns)).alias("a")).collect()]


def test_splitter_in_one_function(spark):
    rng = random.Random(4)
    words = ["r.", "Av", "João", "joão", "7", "007", "²", "1º", "n", "ap", "bl. B", "日本", "\x1c", "\xad", "\x85", "\xa0", ",", "-", "_", "S/N", "‍", "é", "٣", " "]
    rows = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in [*rows, *rows[:50], None, ""]], "v string").coalesce(1)
    model = split.Model(
        ["B-COM", "B-LOC", "B-LOG", "B-NUM", "I-LOG", "O"],
        {"0:is_alpha": {"I-LOG": 1.0}, "BOS": {"B-LOG": 2.0}, "0:is_digit": {"B-NUM": 1.0}, "0:is_punct": {"O": 1.0}, "0:AP": {"B-COM": 3.0}, "-1:AP": {"I-LOG": 0.1}, "0:is_unknown": {"B-LOC": 1.1}, "tem_pontuacao:+1": {"I-LOG": 0.3, "O": 0.1}},
        {("B-COM", "I-LOG"): 1.3, ("O", "B-NUM"): 0.2},
    )
    fields, standard = _by_steps(df, model)
    got = df.select(split.split_address(F.col("v"), model).alias("a"), split.split_standardized(F.col("v"), model).alias("b")).collect()
    assert [None if r.a is None else r.a.asDict() for r in got] == [*fields[:350], None, fields[-1]]
    assert [tuple(r.b) for r in got] == standard
    assert [tuple(r)[1:] for r in tables.split_address_table(df, model, "v").collect()] == standard


def test_latin_tokens(spark):
    """Up to U+024F both ways of cutting agree on every character."""
    rows = [f"a{chr(k)}1{chr(k)}{chr(k)} {chr(k)}" for k in range(0x250)]
    df = spark.createDataFrame([(r,) for r in rows], "v string").coalesce(1)
    assert [r.x for r in df.select(split.tokenize(F.col("v")).alias("x")).collect()] == [split._LATIN_TOKEN.findall(r) for r in rows]


def test_addresses_are_tagged_once_a_worker(monkeypatch):
    """Repeats in later batches cost nothing: before, each batch began anew."""
    tagged = []
    monkeypatch.setattr(split, "_walk", lambda tokens, *_: tagged.append(tokens) or iter(()))
    run = split._tagger(split.Model(["O"])).func
    for _ in range(3):
        run(pd.Series([["RUA", "A"], None, ["RUA", "A"]]))
    assert tagged == [("RUA", "A")]


def test_split_table_calls_python_once(spark):
    """One function does the whole job: before, there were five, over fields that were sent back and forth."""
    df = spark.createDataFrame([("RUA A, 1",)], "DscEndereco string")
    plan = tables.split_address_table(df, split.Model(["O"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_quartiles_of_odd_values(spark):
    """As ``percentile`` gives them, ties, NaN, infinities, zeros and nulls included."""
    rng = random.Random(6)
    odd = [0.0, -0.0, 1e-310, -1e-310, 1e308, -1e308, float("nan"), float("inf"), float("-inf"), None, 1.0, 1.0 + 2**-52]
    draws = [lambda: rng.gauss(0, 1e9), lambda: rng.choice(odd), lambda: float(rng.randint(0, 3)), lambda: None]
    for size in (1, 2, 3, 500):
        rows = [(*(d() for d in draws), rng.randint(-(2**63), 2**63 - 1), "x") for _ in range(size)]
        df = spark.createDataFrame(rows, "a double, b double, c double, d double, e bigint, s string").repartition(3)
        got = {r.column: r for r in prepare.summarize(df).collect()}
        assert set(got) == set(df.columns) and got["s"].q50 is None
        want = df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(q / 100)).alias(f"{c}{q}") for c in "abcde" for q in (25, 50, 75)]).first()
        assert [str(got[c][f"q{q}"]).replace("-0.0", "0.0") for c in "abcde" for q in (25, 50, 75)] == [str(want[f"{c}{q}"]).replace("-0.0", "0.0") for c in "abcde" for q in (25, 50, 75)]


def test_no_task_gets_all_values(spark):
    """No aggregate keeps a buffer of distinct values: before, three percentiles of a column did."""
    df = spark.range(10).select("id", F.col("id").cast("string").alias("s"))
    plan = prepare.summarize(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    assert prepare.summarize(df.select("s")).first().q25 is None


def test_addresses_use_all_cores(spark, tmp_path):
    """A table in one row group was one task for all that is made of its addresses."""
    spark.range(2000).selectExpr("id AS c_custkey", "concat('C ', id) AS c_name", "CAST(id % 3 AS INT) AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N ', id) AS n_name").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    for name in ("labelled_rows", "features", "assemble", "address_format", "address_standardize"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        rows = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(rows) == 2000 and max(rows) < 500, name
