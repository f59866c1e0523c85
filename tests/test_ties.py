"""Lines of an order with the same number: the same one stays in whatever order they are read, and in SQL."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["parent_span_join", "symbol_range_join"])
def test_equal_line_numbers(spark, tmp_path, name):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    answers = []
    for order in ("l_suppkey", "l_suppkey desc"):
        sf = tmp_path / order.replace(" ", "-")
        sf.mkdir()
        for f in os.listdir(SF):
            os.symlink(f"{SF}/{f}", sf / f)
        os.unlink(sf / "lineitem.parquet")
        c = duckdb.connect()
        c.execute(f"copy (select * replace (1 + l_linenumber % 2 as l_linenumber, l_orderkey % 40 as l_orderkey) from '{SF}/lineitem.parquet' order by {order}, l_quantity desc) to '{sf}/lineitem.parquet' (format parquet)")
        for t in ("lineitem", "supplier"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        done = c.execute(e.oracle_sql()[name])
        names = [d[0] for d in done.description]
        answers.append(sorted(done.fetchall()))
        answers.append(sorted(tuple(r[n] for n in names) for r in e.queries()[name](spark, str(sf)).collect()))
    assert answers[0] and all(a == answers[0] for a in answers)
