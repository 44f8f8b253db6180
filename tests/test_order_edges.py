from hopspark.sources import testdata
from oracle import SF, connect


def test_an_edge_per_line(spark):
    lines = connect().execute("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()[0]
    assert testdata.order_edges(spark, SF).count() == lines
