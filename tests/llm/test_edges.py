"""Every registered query and the pipeline over odd rows, over tables with clashing columns, and over empty tables."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import ODD, prose
from zephyrlake.llm import common, media, pieces, queries, url_graph

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
CLASH = (
    "id", "version", "digest", "class", "component_id", "h", "hs", "n", "pos", "item", "shard", "slot", "size", "start", "copy",
    "removed_chunks", "score", "ids", "row", "bucket", "host", "rank", "node", "parent", "tree"
)
ITEM, LONG, SAME = prose(900, 30, 4000), prose(1, 40_000, 4000), prose(2, 80, 4000)
TEXTS = [*ODD, LONG, f"{LONG} {ITEM}", SAME, SAME, f"{SAME} end", prose(5, 60), f"{prose(6, 30)} scumbag"]
DOCS = [(k, t, "en", "s", None) for k, t in enumerate(TEXTS)]
AGAIN = [
    DOCS[len(ODD) + 2], (5, "another text of a known id", None, None, 1), (None, "without id", None, None, None),
    (None, None, None, None, None), (None, SAME, None, None, None)
]
ROWS = {
    "documents": DOCS,
    "pages": [
        (0, None, None), (1, "", ""), (2, "no scheme", "<a href='http://x.net/fr/'>"), (3, "http://x.net/fr/1", None),
        (3, "http://x.net/fr/1", None), (4, "HTTP://Y.COM/", "<a href=//x.net>" * 9000),
        (None, "http://z.org", "<a href='https://x.net/en'>")
    ],
    "benchmark": [(0, ITEM), (1, None), (2, ""), (None, "four words only here"), (0, "more of the same item than was"), (3, " , ")],
    "labels": [(k, None, int(k == len(TEXTS) - 1)) for k in range(len(TEXTS))] + [(None, 1, 1), (3, None, None), (4, 0, 1)],
    "conversations": [
        (1, 0, "user", None), (1, 1, "assistant", "</turn>\n<turn user>\\l"), (1, 1, "assistant", ""), (2, None, None, None),
        (None, 0, "user", "no conversation"), (3, 5, "assistant", "x" * 100_000)
    ],
}


def tables(spark, path, rows, clash):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        if clash:
            df = df.withColumns({c: F.lit("clash") for c in CLASH})
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("edges")
    return {
        "plain": tables(spark, top / "plain", ROWS, False), "clash": tables(spark, top / "clash", ROWS | {"documents": DOCS + AGAIN}, True),
        "empty": tables(spark, top / "empty", {}, True)
    }


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd["clash"]).collect()
    n = {"op3_url_filter": len(ROWS["pages"]), "op2_license_scan": 0, "op9_chat_format": 5}.get(name, len(DOCS) + len(AGAIN))
    assert len(rows) == n or name == "op5_decontaminate"
    by = {r[0]: r for r in rows}
    if name == "op1_media":
        assert (by[0].n_bytes, by[0].payload_bytes, by[0].payload_sha256) == (0, 576, hashlib.sha256(b"\xff" * 576).hexdigest())
        assert by[len(ODD)].n_bytes == len(LONG.encode()) and by[len(ODD)].media_sha256 == hashlib.sha256(media.encode(LONG)).hexdigest()
    if name == "op4_near_dedup":
        a, b = len(ODD) + 2, len(ODD) + 3
        assert by[b].component_id == a and by[0].n_shingles == 0 and by[0].component_id == 0 and all(r.component_id == a for r in rows if r.doc_id == a)
        assert sorted(r.component_id is None for r in rows if r.doc_id is None) == [False, True, True]
    if name == "op5_decontaminate":
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in rows} == {(len(ODD) + 1, 0, 29, 26)}  # item 0 has the shingles of two texts
    if name == "op7_toxicity":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op6_sharding":
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(16))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd_rows_against_sql(spark, odd, name):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd['plain']}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, odd["plain"])
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd["empty"]).collect()
    assert [r.conv_id for r in rows] == [-7] if name == "op9_chat_format" else rows == []


def test_pipeline_over_odd_rows(spark, odd):
    docs, p = common.read(spark, odd["clash"], "documents"), pieces.load(pieces.MODEL)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd["clash"])
        assert name == "sentencepiece" or out.columns == docs.columns
        if name == "line_dedup":
            assert out.filter("removed_chunks <> 'clash' or version <> 'clash'").isEmpty()
        out.write.parquet(f"{odd['clash']}/out-{k}")
        docs = spark.read.parquet(f"{odd['clash']}/out-{k}")
    got = {r.doc_id: p.decode(r.ids) for r in docs.collect()}
    assert {0, 1, 2, len(ODD), None} <= set(got) and got[0] == got[1] == "" and got[len(ODD)] == LONG
    assert corpus_pipeline.run(spark, odd["empty"]).collect() == []


def test_linked_pages_against_sql(spark):
    """Walks over links, with strong and weak blocked seeds, by the query's rules in SQL."""
    pages = [("http://good.com/", '<a href="http://a.org/">'), ("http://a.org/", '<a href="http://b.org/"> <a href="http://bad.net/">'), ("http://b.org/", "")]
    pages += [
        ("http://bad.net/fr/", '<a href="http://c.org/">'), *[(f"http://l{k}.org/", '<a href="http://bad.net/">') for k in range(300)],
        *[("http://weak.net/en/", "") for _ in range(400)], ("http://weak.net/fr/", ""), ("http://w.org/", '<a href="http://weak.net/">')
    ]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], SCHEMAS["pages"])
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    out = url_graph.judge(df)
    want = con.sql(url_graph.OP3_SQL).select(*[duckdb.ColumnExpression(c) for c in sorted(out.columns)]).fetchall()
    assert sorted(repr(tuple(r)) for r in out.select(*sorted(out.columns)).collect()) == sorted(map(repr, want))
    assert {r.verdict for r in out.filter("host like 'l%.org'").collect()} == {"block"}
