import hashlib

import duckdb

from corpuslens.llm import warc
from corpuslens.llm.queries import QUERIES, SQL

PAGES = [
    (1, "http://a/", "<html><title>A &amp; B</title><!-- x --><script>var t='</p>';</script><p>One<br>two &lt;b&gt; &#39;q&#x27; &#8364; &amp;lt;</p><a class=x href='/l'>go</a></html>"),
    (2, None, None), (3, "u", ""), (None, "u", "<p>no id"), (4, "http://b/", "plain"), (4, "http://b/", "plain"), (5, "x", "&#55296; &#0; &#99999999; <STYLE>p{}</STYLE>t" + "<div>y" * 5000),
]


def test_query_equals_sql_on_edge_pages(spark, tmp_path):
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, block string, record_id string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op1_warc_derivatives"](spark, str(tmp_path)).toPandas()
    connection = duckdb.connect()
    connection.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    expected = connection.sql(SQL["op1_warc_derivatives"]).df()
    rows = lambda f: sorted(f[got.columns].fillna({"page_id": -1}).astype({"page_id": int}).itertuples(index=False, name=None))
    assert rows(got) == rows(expected)


def test_records_are_linked(spark):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    source = warc.responses_of_pages(pages).first()
    records = {r["warc_type"]: r for r in warc.derivatives(warc.responses_of_pages(pages)).select("*", warc.record_text().alias("record")).collect()}
    text, fields = records["conversion"], records["metadata"]
    assert text["block"] == "A & B\nOne\ntwo <b> 'q' € &lt;\ngo"
    assert {text["refers_to"], fields["refers_to"]} == {source["record_id"]} and text["record_id"] in fields["block"]
    assert "outlink: /l L a/@href\r\n" in fields["block"] and "source-header: HTTP/1.1 200 OK\r\n" in fields["block"]
    assert fields["source_payload_digest"] == "sha256:" + hashlib.sha256(PAGES[0][2].encode()).hexdigest()
    assert f"Content-Length: {len(text['block'].encode())}\r\n" in text["record"] and text["record"].startswith("WARC/1.1\r\n")


def test_empty_table(spark):
    assert warc.derivatives(warc.responses_of_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string").limit(0))).count() == 0


def test_all_references_and_unquoted_links(spark):
    bodies = [
        "it&rsquo;s &ldquo;caf&eacute;&rdquo; f&uuml;r &bull; &copy 2020 &nosuch; R&D & &AMP;lt; &amp;eacute; &#38;amp; &NotEqualTilde; &#8364;&#x27;",
        "<a href=/one>1</a> <A class=x HREF = two.html id=y>2</a> <a href='three four'>3</a> <a href=\"\">4</a> <a name=z>5</a>",
        "".join(f"[{name} &{name} ]" for name in warc.html5 if name.endswith(";") and name not in ("nbsp;", "Tab;", "NewLine;")),
    ]
    pages = spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    records = {(r["page_id"], r["warc_type"]): r["block"] for r in warc.derivatives(warc.responses_of_pages(pages)).collect()}
    assert records[0, "conversion"] == "it’s “café” für • © 2020 &nosuch; R&D & &lt; &eacute; &amp; ≂̸ €'"
    assert [x for x in records[1, "metadata"].split("\r\n") if x.startswith("outlink")] == [f"outlink: {u} L a/@href" for u in ("/one", "two.html", "three four", "")]
    assert records[2, "conversion"] == "".join(f"[{name} {char} ]" for name, char in warc.html5.items() if name.endswith(";") and name not in ("nbsp;", "Tab;", "NewLine;"))
