"""Predicates, inference and names, against plain statements of the rules."""

import math
import random
import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import names, predicates
from tessera.operators.profile import as_text, finished, profile, states, united, with_precision


def can(f, *a):
    try:
        f(*a)
        return True
    except ValueError:
        return False


def rules(v):
    low = v.lower()
    return {
        "boolean": low in predicates.TRUE_FALSE, "integer": can(int, v), "decimal": bool(re.fullmatch(r"[+-]?\d+(\.\d+)?", v)), "float": can(float, v),
        "date": any(can(datetime.strptime, v, f) for f in ("%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y")),
    }


EDGES = ["1", "-1", "+0", "1_000", "1__0", "_1", "1.", ".5", "1e5", "1e", "nan", "-inf", "Infinity", "1d", "1.5f", "0x1", "1,5", "1 2", "٣", "1.5", "1.5.5", "-", "", "true", "NO", "t", "2024-01-05", "2024-1-5", "31-12-2023", "31/12/2023", "12/31/2023", "13/13/2023", "2024-02-30", "24-01-01", "0000-01-01"]


def test_predicates_on_edges(spark):
    rows = spark.createDataFrame([(v,) for v in EDGES], "v string").select("v", *(predicates.PREDICATES[p](F.col("v")).alias(p) for p in rules("")))
    for r in rows.collect():
        assert {p: r[p] for p in rules("")} == rules(r.v), r.v


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-._eE/ TZ:nafi", max_size=12), min_size=100, max_size=300))
def test_predicates_on_any_text(spark, values):
    rows = spark.createDataFrame([(v.strip(),) for v in values], "v string").select("v", *(predicates.PREDICATES[p](F.col("v")).alias(p) for p in rules("")))
    for r in rows.collect():
        assert {p: r[p] for p in rules("")} == rules(r.v), r.v


def kind(spark, *values):
    return profile(spark.createDataFrame([(v,) for v in values], "c string")).first()


def test_inference_order(spark):
    cases = {
        ("yes", "no"): "BOOLEAN", ("0", "1"): "INTEGER", ("1_000", "NULL"): "INTEGER", ("10.50", "3"): "DECIMAL", ("1e-3", "2.5"): "FLOAT", ("2024-01-01 10:00:00", "x"): "NAIVE_TIMESTAMP",
        ("2024-01-01T10:00:00Z", "2024-01-02T11:30:00+05:30"): "TIMESTAMP", ("2024-01-05", "31-12-2023"): "DATE", ("POINT(1 2)", "polygon(1)"): "GEOGRAPHY",
        ("[2024-01-01,2024-02-01)", "(2024-01-01 , 2024-02-01]"): "RANGE_DATE", ("hello",): "STRING", (None, "", "Null"): "STRING", (" ", "1"): "STRING",
    }
    for values, want in cases.items():
        assert kind(spark, *values).data_type == want, values
    assert kind(spark, "0", "1").ambiguous_boolean and not kind(spark, "yes", "no").ambiguous_boolean


def test_statistics(spark):
    r = with_precision(profile(spark.createDataFrame([("12345",), ("0.123",), (" x ",), ("x",), (None,), ("NULL",), (" ",)], "c string"))).first()
    assert (r.n, r.n_blank, r.n_kept, r.n_distinct, r.nullable, r.max_length) == (7, 2, 5, 4, True, 5)
    assert math.isclose(r.distinct_ratio, 0.5714) and math.isclose(r.null_ratio, 0.2857)
    d = with_precision(profile(spark.createDataFrame([("12345",), ("-0.123",)], "c string"))).first()
    assert (d.precision, d.scale, d.fit_precision, d.signed) == (5, 3, 8, True)
    assert profile(spark.createDataFrame([], "c string")).collect() == []


def test_names(spark):
    raw = ["FirstName", "customerID", "HTTPServer", "userID2Name", "a b", "a-b", "2020 Sales", "order", "é"]
    rows = spark.createDataFrame([("e", i, n, "finance_sales_gold") for i, n in enumerate(raw)], "entity string, ord int, raw_name string, table_name string")
    got = [r.final_name for r in names.with_final_names(rows).orderBy("ord").collect()]
    assert got == ["first_name", "customer_id", "httpserver", "user_id2_name", "a_b", "a_b_2", "_2020_sales", "finance_sales_gold_order", "_"]


MIXED = ["", "0", "1.", ".5", "-.5", "1_0", "1e-5", "-inf", "Infinityx", "yes", "T", "5-1-2024", "2024-01-05T10:00:00Z", "2024-01-05 10:00Z", "2024-1-5T1:2:3", "2024-01-05 24:00:00", "0000-01-05 10:00:00", "POINT(1 2)", "point(", "POINT (1)",
         "[2024-01-01,2024-02-01)", "[x]", "١٢٣", "١.٥", "ınf", "--1", "é", "-2024-01-01", "2024-01-05e", "9" * 40]


def test_mask_holds_every_predicate(spark):
    rng = random.Random(1)
    texts = EDGES + MIXED + ["".join(rng.choices("0123456789-/.:TZe+_ inftrueyPO([,)١", k=rng.randint(1, 12))).strip() for _ in range(1500)]
    for _ in range(1500):
        day = rng.choice(["{0}-{1}-{2}", "{2}-{1}-{0}", "{1}/{2}/{0}"]).format(rng.choice(["2024", "0000", "1999", "24"]), rng.choice(["01", "1", "12", "13", "02"]), rng.choice(["1", "05", "29", "30", "31", "32"]))
        texts.append((day + rng.choice(["", "", "T", " ", "  "]) + rng.choice(["", "", "10:00:00", "1:2:3", "24:00:00", "23:59:60", "10:00", "10:00:00.5"]) + rng.choice(["", "Z", "+05:30", "-08:00"])).strip())
    v = F.col("v")
    known = {**{n: p(v) for n, p in predicates.PREDICATES.items()}, "naive": predicates.is_naive_timestamp(v), "minus": v.startswith("-")}
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", predicates.mask(v).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in known.items()))
    for r in rows.collect():
        assert {n for n in known if r[n]} == {n for n in known if r["mask"] & predicates.BITS[n]}, r.v


def test_no_text_is_shuffled_and_states_unite(spark):
    rows = spark.range(0, 4000, 1, 3).select((F.col("id") % 700).cast("string").alias("a"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("b"))
    for made in (profile(rows), profile(rows, lg=12)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") >= 1 and all("v#" not in line for line in plan.splitlines() if "Exchange" in line)
    exact = {r["name"]: r.asDict() for r in profile(rows).collect()}
    whole = {r["name"]: r.asDict() for r in profile(rows, lg=12).collect()}
    cells = as_text(rows.withColumn("batch", F.spark_partition_id()), keep=["batch"])
    parts = {r["name"]: r.asDict() for r in finished(united(states(cells, ("batch", "ord", "name")))).collect()}
    assert parts == whole
    for name, r in exact.items():
        assert abs(whole[name]["n_distinct"] - r["n_distinct"]) <= 0.08 * r["n_distinct"]
        loose = ("n_distinct", "distinct_ratio")
        assert {k: x for k, x in r.items() if k not in loose} == {k: x for k, x in whole[name].items() if k not in loose}


def test_generated_code_agrees(spark):
    """The suite runs without code generation; profiles are the same with it."""
    rows = spark.createDataFrame([(v, v[::-1]) for v in EDGES + MIXED], "a string, b string")
    plain = sorted(map(str, profile(rows).collect()))
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        made = profile(rows)
        assert "*(1)" in made._jdf.queryExecution().executedPlan().toString() or made.count() == 2
        assert sorted(map(str, made.collect())) == plain
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
