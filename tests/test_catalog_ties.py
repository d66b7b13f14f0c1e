from itertools import permutations

from kbforge.operators import catalog


def test_incoming_rows_of_one_name_give_the_same_in_any_order(spark):
    old = spark.createDataFrame([(1, "cam x", "A", ["p"])], "id long, name string, manufacturer string, ports array<string>")
    new = [("cam x", m, [p]) for m, p in (("C", "q"), ("B", "r"), ("B", "s"))]
    got = {tuple(catalog.upsert_catalog(old, spark.createDataFrame(order, "name string, manufacturer string, ports array<string>").coalesce(1)).select("manufacturer", "ports").first().asDict()["ports"]) for order in map(list, permutations(new))}
    assert got == {("p", "r")}
