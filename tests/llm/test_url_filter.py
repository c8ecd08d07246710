import duckdb
from pyspark.sql import functions as F

from tessera.llm import url_filter
from tessera.llm.components import connected_components

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def link(url):
    return f'<head><LINK href="{url}" rel=canonical></head>'


ROWS = [
    (1, "http://A.b.NET/x", None), (2, "http://example.net/en/1", ""), (3, "https://w.example.com/de/?q", "x"),
    (4, "http://m.q.org/fr/a", ""), (5, None, link("http://a.net/")), (6, "nothing", ""), (7, "http://x.com", link("http://bad.net/1")),
    (8, "http://y.com/a/b?c#d", link("//x.com")), (9, "http://z.com/p", '<meta http-equiv="refresh" content="0; url=/q">'),
    (10, "http://z.com/q", '<link rel="canonical" href="http://ok.org/fr/z">'), (11, "http://z.com/q#frag", link("http://bad.net/1")),
    (16, "HTTP://Two.com/X?utm_a=1&b=2&utm_c=3#f", link("HTTPS://ONE.com/Q#g") + link("//bad.NET/2")), (17, "https://two.com/X?b=2", None), (18, "https://one.com/Q?utm_source=feed", ""), (19, "http://one.com/Q", ""),
    (12, "http://lone.com/a", ""), (12, "http://lone.com/a", ""), (13, "http://netx/", ""), (14, "http://net", ""), (15, "://h/p\nq?x", ""),
]


def test_rules_and_aliases_match_sql(spark):
    rows = [(i, u, h, "clash", "clash") for i, u, h in ROWS]
    got = url_filter.judge_urls(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", ROWS)
    want = con.execute(f"select {', '.join(got.columns)} from ({url_filter.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    verdicts = {r[0]: r.verdict for r in got.collect()}
    assert verdicts[7] == "allow" and verdicts[8] == "allow"  # the group also holds ok.org/fr through bad.net
    assert {verdicts[i] for i in (16, 17, 18, 19)} == {"block"} and len({r.alias_group for r in got.collect() if r[0] in (16, 17, 18, 19)}) == 1  # over the second link
    assert verdicts[1] == "block" and verdicts[14] == "allow" and verdicts[3] == "block"


def test_block_spreads_without_an_allow(spark):
    rows = [(1, "http://x.com/", link("http://bad.net/1"), "", ""), (2, "http://y.com/", link("http://x.com/"), "", "")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.verdict for r in got] == ["block", "block"] and len({r.alias_group for r in got}) == 1
    logged = spark.createDataFrame([("http://y.com/#a", "http://ok.org/fr/")], "a string, b string")
    got = url_filter.judge_urls(spark.createDataFrame(rows, SCHEMA), redirects=logged).collect()
    assert [r.verdict for r in got] == ["allow", "allow"]


def test_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_long_paths_and_hubs(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(500).select((F.col("id") + 1000).alias("a"), F.lit(5000).cast("long").alias("b"))
    got = dict(map(tuple, connected_components(path.union(hub).union(path)).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in [*range(1000, 1500), 5000]}


def test_mixed_case_canonical_links_match_sql(spark):
    pages = [(1, "http://x.com/", '<link rel="Canonical" href="http://bad.net/1">'), (2, "http://y.com/", "<LINK href='http://ok.org/fr/' REL=cAnOnIcAl>")]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = con.execute(f"select {', '.join(got.columns)} from ({url_filter.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def test_forms_meet_links_only(spark):
    rows = [
        (1, "http://x.com/a?utm_source=mail", link("http://bad.net/1"), "", ""), (2, "https://x.com/a", "", "", ""), (3, "http://x.com/a", "", "", ""), (4, "http://x.com/b", "", "", ""), (5, "https://x.com/b", "", "", ""),
        (6, "http://y.com/c", link("http://x.com/a?utm_medium=1"), "", ""),
    ]
    got = {r.page_id: (r.verdict, r.alias_group) for r in url_filter.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in (1, 2, 3, 6)} == {("block", "https://bad.net/1")}
    assert got[4] == got[5] == ("allow", None)  # forms of one url alone change nothing


def test_registered_query_with_links_and_a_log(spark, tmp_path):
    """The given pages hold no link: the registered function over a table that does, and the operator with a log of redirects between given pages."""
    pages = [(1, "http://x.com/", link("http://bad.net/1")), (2, "https://x.com/?utm_a=1", None), (3, "http://z.com/", link("http://x.com")), (4, "http://bad.net/1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in url_filter.op1_url_redirects(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}  # http://x.com and http://x.com/ are two nodes
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("url like '%://%'").select("page_id", "url", "html")
    plain = url_filter.judge_urls(given)
    blocked = plain.where("verdict = 'block'").join(given, "page_id").select("url").orderBy("page_id").limit(1)
    free = plain.where("rule is null").join(given, "page_id").select("page_id", "url").orderBy("page_id").limit(20)
    log = free.select(F.col("url").alias("a")).crossJoin(blocked.select(F.col("url").alias("b")))
    judged = {r.page_id: r.verdict for r in url_filter.judge_urls(given, redirects=log).collect()}
    before = {r.page_id: r.verdict for r in plain.collect()}
    moved = {i for i in judged if judged[i] != before[i]}
    assert {r.page_id for r in free.collect()} <= moved and {judged[i] for i in moved} == {"block"}


def test_query_has_alias_groups(spark):
    """The given pages hold no link, but forms of the same url: their groups are not empty."""
    got = url_filter.op1_url_redirects(spark, "/root/testdata/sf0.01")
    assert got.where("alias_group is not null").count() > 50


def test_registered_query_groups_every_form(spark, tmp_path):
    """Forms that no link meets, forms met over a link to a url that is no page, links and refreshes: the registered function equals its SQL."""
    pages = [*ROWS, (20, "http://x.com/b", ""), (21, "https://x.com/b?utm_a=1", None), (22, "https://x.com/b", ""), (23, "http://v.com/", link("http://w.com/?utm_a=1")), (24, "https://w.com/?utm_b=2", link("http://bad.net/3"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = url_filter.op1_url_redirects(spark, str(tmp_path))
    got = {r.page_id: r for r in made.collect()}
    assert {got[i].alias_group for i in (20, 21, 22)} == {"http://x.com/b"} and got[12].alias_group == "http://lone.com/a"
    assert got[23].alias_group == got[24].alias_group and got[23].verdict == "block"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(made.columns)} from ({url_filter.QUERY_SQL})").fetchall()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
