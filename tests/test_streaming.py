from pyspark.sql import functions as F

from tessera.operators.registry import Registry
from tessera.streaming.watch import profiled, watch


def test_watch(spark, tmp_path):
    """Two batches of the same types, then one that breaks a type: warned of, then let through as a new version."""
    for name in ("in", "report", "cp"):
        (tmp_path / name).mkdir()
    put = lambda n, rows: (tmp_path / "in" / f"{n}.csv").write_text("id,note\n" + rows)
    place = lambda n: f"file://{tmp_path}/{n}"

    def run(policy):
        stream = spark.readStream.schema("id string, note string").option("header", True).csv(place("in"))
        watch(stream, "notes", place("registry"), place("report"), place("cp"), policy).awaitTermination()

    put("a", "1,x\n2,y\n")
    run("WARN")
    put("b", "3,z\n")
    run("WARN")
    put("c", "four,z\n")
    run("WARN")
    put("d", "five,z\n")
    run("AUTO")
    got = [tuple(r) for r in spark.read.parquet(place("report/verdict")).orderBy("batch").select("decision", "status", "version").collect()]
    assert got == [("CREATE", "SUCCESS", 1), ("NO_OP", "SUCCESS", 1), ("BREAKING", "WARNING", 1), ("BREAKING", "SUCCESS", 2)]
    assert '"TYPE_CHANGE"' in spark.read.parquet(place("report/verdict")).where("batch = 2").first().changes
    assert spark.read.parquet(place("report/states")).where("batch = 0").count() == 2
    seen = {r["name"]: (r.n, r.n_distinct, r.data_type) for r in profiled(spark, place("report")).collect()}
    assert seen == {"id": (5, 5, "STRING"), "note": (5, 3, "STRING")}
    assert Registry(spark, place("registry")).current("notes").version == 2
    assert Registry(spark, place("nowhere")).rows().agg(F.count("*")).first()[0] == 0
