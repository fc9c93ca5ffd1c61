"""Plans that read and move no more than a query asks for."""

from entigraph.operators import changes
from entigraph.plans import catalog

SF = "/root/testdata/sf0.001"


def test_any_step_from_orders_reads_orders_only(spark):
    names = lambda q: {f.rsplit("/", 1)[-1] for f in catalog.QUERIES[q](spark, SF).inputFiles()}
    assert names("g8_any") == {"orders.parquet"}
    assert names("g10_not") == {"orders.parquet", "lineitem.parquet"}


def test_lines_of_orders_are_read_once_a_version(spark):
    for version in catalog._nested_versions(spark, SF):
        assert version._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2


def test_a_checked_patch_makes_its_join_once(spark):
    old = spark.createDataFrame([(1, {"a": 1, "b": 2}, [1, 2, 3])], "id int, m map<string,int>, xs array<int>")
    new = spark.createDataFrame([(1, {"a": 1, "c": 5}, [1, 4])], "id int, m map<string,int>, xs array<int>")
    out = changes.patch(old, changes.diff_snapshots(old, new))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, {"a": 1, "c": 5}, [1, 4])]
