"""Each catalog query against its SQL text in another engine, on the smallest tables where they exist."""

import os
from collections import Counter

import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(str([canonical(x) for x in r]) for r in df.select(*columns).collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(str([canonical(r[k]) for k in order]) for r in cursor.fetchall())
    assert rows == expected


def _both(spark, duck, folder, name, pages):
    """Rows of a query over the given pages, and those of its SQL."""
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    df = catalog.queries()[name](spark, str(folder))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())


_OPEN = "<title>A &amp;&amp; b&amp</title><body><article>x &lt;b&gt; &copy; y&amp</article></body>"


def test_unclosed_references_of_flat_pages_stay(spark, duck, tmp_path):
    got, expected = _both(spark, duck, tmp_path, "html_main_text", [(1, "https://a.test/1", _OPEN), (2, "https://a.test/2", "<body>&amp;lt; &quo</body>")])
    assert got == expected
    assert got[0][2:] == ("A && b&amp", "x <b> © y&amp")


def test_latest_page_counts_unclosed_references(spark, duck, tmp_path):
    got, expected = _both(spark, duck, tmp_path, "post_latest", [(k, "https://a.test/1", _OPEN) for k in (1, 2)])
    assert got == expected
    assert [r[3:] for r in got] == [(1, len("x <b> © y&amp"))]


def test_latest_page_keeps_other_spaces_and_mixed_tags(spark, duck, tmp_path):
    inner = ["x\u3000", "x \u2028", "x\x0b", "\x1cx", "x<style>a<script>b</style>c</script>d"]
    pages = [(k, f"https://a.test/{k}", f"<title>t{x}</title><body><article>{x}</article></body>") for k, x in enumerate(inner)]
    got, expected = _both(spark, duck, tmp_path, "post_latest", pages)
    assert got == expected
    assert sorted(r[3:] for r in got) == [(0, 2), (1, 3), (2, 2), (3, 2), (4, 3)]


def test_addresses_with_a_fragment_are_their_own(spark, duck, tmp_path):
    urls = ["https://a.test/x", "https://a.test/x#top", "https://a.test/x%23top", "https://a.test/y#1", "https://a.test/x"]
    got, expected = _both(spark, duck, tmp_path, "take_urls", [(3 * k, u, "") for k, u in enumerate(urls)])
    assert got == expected
    assert len(got) == 4


def test_near_clusters_over_documents(spark):
    """Representatives are earliest members, and exact clusters never split."""
    forms = catalog.near_duplicates(spark, SF).collect()
    by = {}
    for r in forms:
        by.setdefault(r.cluster, []).append(r.norm)
    assert len({r.norm for r in forms}) == len(forms)
    assert all(len({n[:2] for n in norms}) == 1 for norms in by.values())


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["normalized", "frequency", "question_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
