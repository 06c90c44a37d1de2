"""Queries over contracts take every order."""

from covenant.sources import corpus


def test_every_order_is_a_contract(spark, sf_dir):
    docs = corpus.contracts(spark, sf_dir)
    orders, lines = (corpus.table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    assert docs.count() == orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi").count()
