"""Command line: crawl, search, export, sites, serve, version. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys

from quarry import __version__
from quarry.config import load


def _engine(args):
    from pyspark.sql import SparkSession

    from quarry.engine import Engine

    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return Engine(spark, load(args.config))


def crawl(args) -> str:
    c = _engine(args).crawl(args.url)
    return f"visited {c['visited']}, fetched {c['fetched']}, skipped {c['skipped']}, failed {c['failed']}"


def search(args) -> str:
    if args.fresh:
        print("--fresh has no effect on the command line; ask the server", file=sys.stderr)
    rows = _engine(args).search(args.site, args.query, args.limit, soft=True)
    blocks = []
    for i, r in enumerate(rows, 1):
        price = f" {r['price']:g} {r['currency']}" if r.get("price") is not None else ""
        path = f"\n   {r['heading_path']}" if r.get("heading_path") else ""
        blocks.append(f"{i}. {r['title']} [{r['type']}] {r['score']:.2f}{price}\n   {r['url']}{path}\n   {r['snippet']}")
    return "\n\n".join(blocks) or "no results"


def export(args) -> str:
    from quarry.operators import index
    from quarry.sources import export as out

    e = _engine(args)
    if args.site not in e.sites():
        raise LookupError(f"no index for {args.site!r}: crawl it first")
    if args.format == "markdown":
        return f"{out.copy_kb(e.config.data_dir, args.site, args.out)} files"
    pages, chunks = (e.store.read(t, args.site) for t in ("pages", "chunks"))
    return f"{out.export_jsonl(index.all_chunks(chunks, pages), args.out)} chunks"


def sites(args) -> str:
    rows = _engine(args).stats().orderBy("site").collect()
    line = lambda a, b, c, d, e: f"{a:<32}{b:>8}{c:>8}{d:>10}  {e}"
    return "\n".join([line("SITE", "PAGES", "CHUNKS", "PRODUCTS", "LAST CRAWLED"), *(line(r.site, r.pages, r.chunks, r.products, r.last_crawled) for r in rows)])


def serve(args) -> str:
    from quarry.server import run

    run(_engine(args))
    return ""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--config", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, words in (("crawl", crawl, ["url"]), ("search", search, ["site", "query"]), ("export", export, ["site"]), ("sites", sites, []), ("serve", serve, []), ("version", lambda _: f"quarry {__version__}", [])):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for w in words:
            s.add_argument(w)
        if name == "search":
            s.add_argument("--limit", type=int, default=10)
            s.add_argument("--fresh", action="store_true")
        if name == "export":
            s.add_argument("--format", choices=["jsonl", "markdown"], default="jsonl")
            s.add_argument("--out", default="export")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        said = args.run(args)
    except (LookupError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if said:
        print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
