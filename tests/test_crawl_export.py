"""Robots, frontier, change detection, sitemaps, exports, streams, configuration, command line, server."""

import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from quarry import cli, config
from quarry.engine import Engine, search_url
from quarry.operators import crawl, index, search
from quarry.server import Api, server
from quarry.sources import export, tables
from quarry.sources.fetch import Fetched
from quarry.streaming import changefeed

ROBOTS = """
User-agent: other
Disallow: /
User-agent: quarry
User-agent: second
Disallow: /private
Allow: /private/open
Disallow: /*?by=
Disallow: /old.asp$
Crawl-delay: 3.25
nonsense
Sitemap: https://x.y/s.xml
User-agent: *
Disallow: /all
"""


@pytest.mark.parametrize(("path", "ok"), [("/private", False), ("/private/open/x", True), ("/a?by=1", False), ("/old.asp", False), ("/old.aspx", True), ("/all", True), ("/", True)])
def test_robots(path, ok):
    r = crawl.parse_robots(ROBOTS, "Quarry/0.1")
    assert r.allowed(path) is ok
    assert (r.delay, r.sitemaps) == (3.25, ["https://x.y/s.xml"])
    assert crawl.parse_robots(ROBOTS, "someone").allowed("/all") is False
    assert crawl.parse_robots("", "x").allowed("/") is True


def test_robots_join(spark):
    rules = crawl.robots_rules(spark.createDataFrame([("s", ROBOTS)], "site string, text string"), "quarry")
    urls = spark.createDataFrame([("s", "https://x.y/private"), ("s", "https://x.y/private/open"), ("t", "https://z/private")], "site string, url string")
    assert sorted(r.allowed for r in crawl.robots_allowed(urls, rules).collect()) == [False, True, True]


def test_robots_automaton():
    """Every pattern of a site at once, against one regular expression each."""
    import random
    import re

    rng = random.Random(6)
    for _ in range(60):
        rules = [("".join(rng.choice("/ab*") for _ in range(rng.randint(1, 6))) + rng.choice(["", "$"]), rng.random() < 0.5) for _ in range(rng.randint(0, 8))]
        automaton = crawl.RobotsAutomaton(rules, most_states=3)
        for _ in range(40):
            path = "/" + "".join(rng.choice("/abc") for _ in range(rng.randint(0, 8)))
            fits = [(len(p), ok) for p, ok in rules if re.match(".*".join(map(re.escape, p.removesuffix("$").split("*"))) + ("$" if p.endswith("$") else ""), path)]
            assert automaton.allowed(path) == max(fits, default=(0, True))[1]


def test_sitemap_reader():
    assert crawl.read_sitemap("\ufeff <urlset><!-- <url><loc>no</loc></url> --><url><loc>a<![CDATA[&b]]></loc><x><loc>no</loc></x></url></urlset>") == ("urlset", ["a&b"])
    assert crawl.read_sitemap('<!DOCTYPE x [<!ENTITY e "e">]><urlset><url><loc>&e;</loc></url></urlset>') == ("", [])
    assert crawl.read_sitemap("<urlset><url><loc>a</loc></url>") == ("", []) and crawl.read_sitemap("<html/>") == ("", []) and crawl.read_sitemap("") == ("", [])
    assert crawl.read_sitemap("<urlset>" + "<url><loc>u</loc></url>" * 9 + "</urlset>", most_bytes=100) == ("", [])


def test_scope_and_diff(spark):
    df = spark.createDataFrame([("https://a.example.com/x",), ("https://example.com/cartoon",), ("https://other.com/x",)], "url string")
    assert [r.url for r in df.filter(crawl.in_scope(F.col("url"), "example.com", (), ("/cart", "("))).collect()] == ["https://a.example.com/x"]
    ddl = "site string, url string, hash string"
    now, old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3")], ddl), spark.createDataFrame([("s", "a", "1"), ("s", "b", "x")], ddl)
    assert {r.url: r.change for r in crawl.state_diff(now, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.url for r in crawl.to_index(now, old).collect()} == {"b", "c"}


def test_bfs(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 0)], "url string, depth int")
    assert {r.url: r.depth for r in crawl.bfs(seeds, links, 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert [r.url for r in crawl.bfs(seeds, links, 5, 3).collect()] == ["a", "b", "d"]


def test_sitemaps(spark):
    files = {
        "root": "<sitemapindex><sitemap><loc>one</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>",
        "one": "<urlset><url><loc> https://x/a?b=1&amp;c=2 </loc></url><url><loc>https://x/b</loc></url></urlset>",
    }
    table = spark.createDataFrame(list(files.items()), "url string, xml string")
    got = crawl.expand_sitemaps(spark.createDataFrame([("root",)], "url string"), lambda level: level.join(table, "url"))
    assert [r.url for r in got.collect()] == ["https://x/a?b=1&c=2", "https://x/b"]
    assert crawl.sitemap_urls(spark.createDataFrame([("u", "<urlset><loc>x</loc>")], "url string, xml string")).count() == 0


def test_exports(spark, tmp_path):
    chunks = spark.createDataFrame([("s", "u", 0, "", "t<>", "T", "", "en")], "site string, page_url string, ord int, heading_path string, text string, title string, description string, lang string")
    assert json.loads(export.jsonl(chunks).first().value) == {"url": "u", "title": "T", "lang": "en", "ordinal": 0, "text": "t<>"}
    pages = spark.createDataFrame([("s", "https://x/a?1", "A", "", "en", None, "h", [], "one", 1), ("s", "https://x/a?2", "A", "", "en", None, "h", [(1, "H")], "two", 2)], "site string, url string, title string, description string, lang string, crawled_at timestamp, hash string, headings array<struct<level:int,text:string>>, markdown string, seq bigint")
    assert export.write_markdown(pages, str(tmp_path)) == 1
    text = (tmp_path / "s/kb/a.md").read_text()
    assert text.startswith("---\nurl: https://x/a?2\n") and text.endswith("---\n\ntwo\n") and "level: 1" in text
    assert export.copy_kb(str(tmp_path), "s", str(tmp_path / "out")) == 1
    with pytest.raises(FileNotFoundError):
        export.copy_kb(str(tmp_path), "none", str(tmp_path / "out"))
    state = {"u": {"etag": "e"}}
    export.save_state(state, str(tmp_path / "state.json"))
    assert export.load_state(str(tmp_path / "state.json")) == state and export.load_state(str(tmp_path / "no.json")) == {}


def test_stream(spark, tmp_path):
    log = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(9)], "k int, seq int, v string")
    log.write.parquet(str(tmp_path / "log"))
    changes = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    run = lambda: changefeed.keep_table(changes, str(tmp_path / "t"), str(tmp_path / "c"), ["k"]).awaitTermination()
    run()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t/v=0")).collect()) == ["v6", "v7", "v8"]
    spark.createDataFrame([(0, 99, "new")], log.schema).write.mode("append").parquet(str(tmp_path / "log"))
    run()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()) == ["new", "v7", "v8"]
    assert [r.v for r in changefeed.poll(log, 5, 2, ["k"]).collect()] == ["v6", "v7"]


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("listen: ':1'\ncrawl:\n  max_depth: 2\n  recrawl_interval: 1h30m\n  include: ['/a']\n")
    monkeypatch.setenv("QUARRY_CRAWL_MAX_DEPTH", "3")
    monkeypatch.setenv("QUARRY_TOKEN", "")
    c = config.load(str(path))
    assert (c.listen, c.crawl.max_depth, c.crawl.recrawl_interval.total_seconds(), c.crawl.include) == (":1", 3, 5400, ["/a"])
    monkeypatch.setenv("QUARRY_CRAWL_MAX_DEPTH", "0")
    with pytest.raises(ValueError, match="max_depth"):
        config.load()
    monkeypatch.setenv("QUARRY_CRAWL_MAX_DEPTH", "x")
    with pytest.raises(ValueError, match="MAX_DEPTH"):
        config.load()


@pytest.mark.parametrize(
    ("home", "wanted"),
    [
        ('<body class="woocommerce">', "https://s.x/?s=tin+kettle"),
        ('<link href="https://cdn.shopify.com/a">', "https://s.x/search?q=tin+kettle"),
        ('<meta name="generator" content="PrestaShop">', "https://s.x/search?controller=search&s=tin+kettle"),
        ('<meta name="generator" content="OpenCart">', "https://s.x/index.php?route=product%2Fsearch&search=tin+kettle"),
        ('<form role="search" action="/seek"><input name="w" type="search"></form>', "https://s.x/seek?w=tin+kettle"),
        ('<form class="search-form" method="post"><input name="w"></form>', None),
        ("<p>", None),
    ],
)
def test_search_url(home, wanted):
    assert search_url(home, "https://s.x", "tin kettle") == wanted


WORDS = "plain words about walking shoes " * 10
SHOP = {
    "https://shop.example/robots.txt": "User-agent: *\nDisallow: /secret\n",
    "https://shop.example/sitemap.xml": "<urlset><url><loc>https://shop.example/map</loc></url></urlset>",
    "https://shop.example/": f'<title>Home</title><main><h1>Home</h1><p>{WORDS}<a href="/p">p</a><a href="/secret">s</a><a href="/cart">c</a></main>',
    "https://shop.example/map": f"<title>Map</title><main>{WORDS}</main>",
    "https://shop.example/p": '<title>P</title><script type="application/ld+json">{"@type":"Product","name":"Walking shoe","offers":{"price":5,"priceCurrency":"USD"}}</script><main><p>shoe</main>',
}


def shop(url, *args, **kw):
    body = SHOP.get(url)
    return Fetched(url, 200, body=body.encode(), content_type="text/html") if body else Fetched(url, 404)


def test_engine_and_api(spark, tmp_path):
    asked = '{"is_product": true, "name": "Told by a model", "price": 2}'
    e = Engine(spark, config.Config(data_dir=str(tmp_path), crawl=config.Crawl(rate_limit_rps=100)), shop, lambda text: asked if text.startswith("Map") else "no")
    assert e.crawl("shop.example") == {"visited": 4, "fetched": 3, "skipped": 0, "failed": 0}
    assert e.crawl("https://shop.example") == {"visited": 4, "fetched": 0, "skipped": 3, "failed": 0}
    assert e.sites() == ["shop.example"]
    got = e.search("shop.example", "walking shoe", soft=True)
    assert (got[0]["url"], got[0]["type"], got[0]["price"]) == ("https://shop.example/p", "product", 5.0)
    with pytest.raises(LookupError):
        e.search("none.example", "x")
    assert [(r["url"], r["extraction_method"]) for r in e.search("shop.example", "told", kind="product")] == [("https://shop.example/map", "llm")]
    found = e.index_of("shop.example")
    plan = search.bm25(found.chunk_postings, found.chunk_stats, ["site", "page_url", "ord"], search.strict_terms("walking"))._jdf.queryExecution().toString()
    assert "EqualTo(term,walking)" in plan
    assert export.copy_kb(str(tmp_path), "shop.example", str(tmp_path / "kb")) == 3
    assert (tmp_path / "kb" / "p.md").read_text().endswith("\n\nshoe\n")
    other = Engine(spark, e.config, lambda url, *a, **k: Fetched(url, 200, body=f"<title>T</title><main>{WORDS}</main>".encode(), content_type="text/html") if url == "https://else.example/" else Fetched(url, 404))
    before = e.store._manifests("shop.example")
    assert other.crawl("else.example")["fetched"] == 1 and other.sites() == ["else.example", "shop.example"]
    assert e.store._manifests("shop.example") == before and e.store.read("pages").count() == 4
    changed = SHOP | {"https://shop.example/map": f"<title>Map</title><main>{WORDS} fresh</main>"}
    later = Engine(spark, e.config, lambda url, *a, **k: Fetched(url, 200, body=changed[url].encode(), content_type="text/html") if url in changed else Fetched(url, 404), e.ask)
    assert later.crawl("shop.example")["fetched"] == 1 and [r["url"] for r in e.search("shop.example", "fresh")] == ["https://shop.example/map"]
    assert index.merged_corpus_stats(e.store.read("stats", "shop.example")).first().n == e.store.read("chunks", "shop.example").count()
    counted = e.stats().filter("site = 'shop.example'").select("pages", "chunks", "products", "extraction_methods").first()
    whole = index.site_stats(*(e.store.read(t, "shop.example") for t in ("pages", "chunks", "products"))).first()
    assert counted == whole.__class__(*(whole[c] for c in ("pages", "chunks", "products", "extraction_methods")))
    api = Api(e)
    live = api.handle("POST", "/v1/search", b'{"site":"shop.example","query":"walking shoe","fresh":true}')
    assert live[0] == 200 and live[1]["source"] == "index+live" and live[1]["results"][0]["verified"]
    items = api.handle("GET", "/v1/sites/shop.example/items?since_seq=0&type=product")[1]
    assert sorted(i["title"] for i in items["items"]) == ["Told by a model", "Walking shoe"]
    assert api.handle("POST", "/v1/search", b'{"site":"shop.example","query":"x","limit":"many"}')[0] == 400
    assert api.handle("GET", "/v1/sites/none/items?since_seq=7")[1] == {"items": [], "next_seq": 7}
    assert api.handle("GET", "/v1/sites/s/items?limit=x")[0] == 400 and api.handle("POST", "/v1/search", b"{}")[0] == 400
    assert 'quarry_index_products{site="shop.example"} 2' in api.handle("GET", "/metrics")[1]
    assert api.handle("GET", "/nowhere")[0] == 404
    e.config.token = "t"
    assert api.handle("GET", "/v1/sites")[0] == 401 and api.handle("GET", "/healthz")[0] == 200
    assert api.handle("GET", "/v1/sites", token="Bearer t")[1]["sites"][1]["pages"] == 3
    e.config.token = ""
    http = server(api, "127.0.0.1", 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/healthz") as r:
        assert json.load(r) == {"status": "ok"}
    http.shutdown()


def test_no_update_is_lost(spark, tmp_path):
    """A crawl commits between a verification's reading and its commit: both changes stay, and only touched buckets are written."""
    e = Engine(spark, config.Config(data_dir=str(tmp_path), crawl=config.Crawl(rate_limit_rps=100)), shop)
    e.crawl("shop.example")
    site, store = "shop.example", e.store
    early = store.snapshot(site)
    sold = spark.createDataFrame([(site, "https://shop.example/u2", "Late mug", "d", 3.0, "USD", "in_stock", "", "json-ld", "", None, 99)], tables.SCHEMAS["products"]).withColumn("bucket", tables.bucket_of("page_url"))
    store.commit(store.snapshot(site), {"products": sold}, [sold.first().bucket], 99)
    with pytest.raises(tables.Conflict):
        store.commit(early, {"products": sold.limit(0)}, [sold.first().bucket])
    before = {r["url"]: r for r in e.search(site, "walking shoe")}
    live = e.verify(site, [before["https://shop.example/p"]])
    assert live[0]["verified"]
    got = {r.page_url: (r.name, r.verified_at is not None) for r in Engine.products_of(store.snapshot(site)).collect()}
    assert got == {"https://shop.example/p": ("Walking shoe", True), "https://shop.example/u2": ("Late mug", False)}
    snap = store.snapshot(site)
    assert snap.seq > 99 and snap.versions["postings"] == early.versions["postings"]  # a request rewrites neither postings nor products
    assert e.stats().first().last_verified is not None
    changed = SHOP | {"https://shop.example/p": SHOP["https://shop.example/p"].replace("<p>shoe", "<p>boot")}
    later = Engine(spark, e.config, lambda url, *a, **k: Fetched(url, 200, body=changed[url].encode(), content_type="text/html") if url in changed else Fetched(url, 404))
    assert later.crawl(site)["fetched"] == 1
    after = store.snapshot(site)
    touched = str(spark.range(1).select(tables.bucket_of(F.lit("https://shop.example/p"))).first()[0])
    for table, versions in snap.versions.items():
        if table != "state":
            assert {b: v for b, v in versions.items() if b != touched} == {b: v for b, v in after.versions[table].items() if b != touched}
    assert after.versions["pages"][touched] != snap.versions["pages"][touched]
    assert after.read("verified").count() == 0 and e.search(site, "boot")[0]["url"] == "https://shop.example/p"
    (tmp_path / "shop.example" / "manifests" / f"{int(after.name[:-5]) + 1:020d}.json").write_text("{")  # a writer died here
    assert store.snapshot(site).versions == after.versions and later.crawl(site)["skipped"] == 3


def test_cold_search(spark, tmp_path):
    pages = {"https://new.example/": '<body class="woocommerce">', "https://new.example/?s=mug": '<li class="product"><a href="/m">Mug</a><span class="price">$3</span></li>'}
    e = Engine(spark, config.Config(data_dir=str(tmp_path)), lambda url, *a, **k: Fetched(url, 200, body=pages[url].encode()) if url in pages else Fetched(url, 404))
    out = e.answer("new.example", "mug")
    assert (out["source"], out["results"][0]["title"], out["results"][0]["price"], out["results"][0]["score"]) == ("site-search", "Mug", 3.0, 1.0)
    assert e.answer("gone.example", "mug")["results"] == []


def test_cli(capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("quarry ")
    assert cli.main(["nonsense"]) == 2 and cli.main([]) == 2
