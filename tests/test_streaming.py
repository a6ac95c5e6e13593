"""The verbs without state take a streaming frame."""

from weftmap.functions import expr as X
from weftmap.operators.relation import Relation
from weftmap.plans.compile import expression


def test_where_select_union_and_a_join_with_a_table(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    (tmp_path / "in").mkdir()
    orders.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = Relation.source(spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in")), "O")
    table = Relation.source(orders, "O")
    customers = Relation.source(spark.read.parquet(f"{sf_dir}/customer.parquet"), "C")

    def made(r):
        big = r.where(expression("O.o_totalprice > 1000", r))
        joined = big.join(customers, X.BinOp("==", X.ColRef("O", "o_custkey"), X.ColRef("C", "c_custkey")))
        some = joined.select([X.ColRef("O", "o_orderkey"), X.ColRef("C", "c_name")])
        return some.union(some, "U").named()

    query = made(stream).writeStream.format("memory").queryName("made").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("made").collect())) == sorted(map(tuple, made(table).collect()))
