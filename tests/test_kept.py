"""Tables that a session computes once."""

from typegraph.plans.kept import kept
from typegraph.plans.scratch import filesystem, remove_path


def test_kept_until_the_tables_change(spark, tmp_path):
    runs = []

    @kept("t")
    def doubled(s, d):
        runs.append(d)
        return s.read.parquet(f"{d}/t.parquet").selectExpr("2 * id as id")

    d = str(tmp_path)
    spark.range(3).write.parquet(f"{d}/t.parquet")
    assert sorted(r[0] for r in doubled(spark, d).collect()) == [0, 2, 4]
    a, b = doubled(spark, d), doubled(spark, d)
    assert a.join(b, a["id"] == b["id"]).count() == 3 and len(runs) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{d}/t.parquet")
    assert doubled(spark, d).count() == 5 and len(runs) == 2
    path = doubled(spark, d).inputFiles()[0].rsplit("/", 1)[0]
    remove_path(spark, path)
    assert not filesystem(spark, path)[0].exists(filesystem(spark, path)[1])
    assert doubled(spark, d).count() == 5 and len(runs) == 3
