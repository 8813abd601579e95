"""The query surface: calls by path, as an HTTP front end would make them. Answers are (status, media type, body).

A call gives the body as one text, stream() in pieces of a row each as they come from the executors, and write() has the
executors write the rows of a query to a folder, so that a result of any size can be had."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans import listing
from quadrille.plans.templates import Template, TemplateError, parse_call, srx_chunks, to_json_rows
from quadrille.session import with_timeout
from quadrille.sparql.engine import Engine
from quadrille.sparql.parser import SparqlError

MEDIA = {"csv": "text/csv", "json": "application/sparql-results+json", "srx": "application/sparql-results+xml"}


GRAPH_MEDIA = {"nt": "application/n-triples", "ttl": "text/turtle"}


def json_chunks(df: DataFrame) -> Iterator[str]:
    """A SPARQL results document in pieces, a row each; ``df`` was asked with terms=True."""
    kinds = {"iri": "uri", "bnode": "bnode", "lit": "literal"}

    def one(t) -> dict:
        out = {"type": kinds[t["k"]], "value": t["v"].removeprefix("_:") if t["k"] == "bnode" else t["v"]}
        if t["lang"]:
            out["xml:lang"] = t["lang"]
        elif t["k"] == "lit" and not t["dt"].endswith("#string"):
            out["datatype"] = t["dt"]
        return out

    yield json.dumps({"head": {"vars": df.columns}}, ensure_ascii=False)[:-1] + ', "results": {"bindings": ['
    for k, r in enumerate(df.toLocalIterator()):
        yield (", " if k else "") + json.dumps({n: one(r[n]) for n in df.columns if r[n] is not None}, ensure_ascii=False)
    yield "]}}"


def csv_chunks(df: DataFrame) -> Iterator[str]:
    cell = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') else v
    yield ",".join(df.columns) + "\r\n"
    for r in df.toLocalIterator():
        yield ",".join(map(cell, r)) + "\r\n"


def triple_lines(df: DataFrame) -> DataFrame:
    """N-Triples, which Turtle contains, of the statements of a CONSTRUCT: one line each."""
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    plain = F.col("o_dt").isin("", "http://www.w3.org/2001/XMLSchema#string")
    tail = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(plain, F.lit("")).otherwise(F.concat(F.lit("^^<"), "o_dt", F.lit(">")))
    obj = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), esc, F.lit('"'), tail)).otherwise(node(F.col("o")))
    return df.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))


def lines(df: DataFrame) -> Iterator[str]:
    for r in df.toLocalIterator():
        yield r[0] + "\n"


def metrics_text(values: dict[str, float]) -> str:
    """Gauges in the Prometheus text format."""
    return "".join(f"# TYPE {k} gauge\n{k} {v:g}\n" for k, v in sorted(values.items()))


class Api:
    """``templates`` by (code, name); ``spaces``: space, ref, root_np; ``shards``: repo, np; ``gauges``: functions."""

    def __init__(self, spark: SparkSession, engine: Engine, templates: list[Template] = (), spaces: DataFrame | None = None, shards: DataFrame | None = None, gauges: dict | None = None, timeout: float = 60):
        self.spark, self.engine, self.spaces, self.shards, self.gauges, self.timeout = spark, engine, spaces, shards, gauges or {}, timeout
        self.templates = {(t.code, t.name): t for t in templates}

    def __call__(self, path: str) -> tuple[int, str, str]:
        try:
            status, media, chunks, seconds = self._route(path)
            return status, media, with_timeout(self.spark, seconds, lambda: "".join(chunks))
        except (TemplateError, SparqlError) as e:
            return 400, "text/plain", str(e)

    def stream(self, path: str) -> tuple[int, str, Iterator[str]]:
        """The body in pieces; no more than a partition of the result is on the driver at a time."""
        try:
            return self._route(path)[:3]
        except (TemplateError, SparqlError) as e:
            return 400, "text/plain", iter([str(e)])

    def write(self, path: str, folder: str) -> None:
        """The rows of /repo and /api calls as files: CSV, or lines of N-Triples."""
        df, _ = self._asked(*self._split(path))
        if df.columns == ["s", "p", "o", "o_kind", "o_dt", "o_lang"]:
            triple_lines(df).write.mode("overwrite").text(folder)
        else:
            _texts(df).write.mode("overwrite").csv(folder, header=True)

    @staticmethod
    def _split(path: str) -> tuple[str, str, dict[str, list[str]]]:
        url = urlsplit(path)
        head, _, rest = url.path.strip("/").partition("/")
        return head, rest, parse_qs(url.query, keep_blank_values=True)

    def _asked(self, head: str, rest: str, args: dict[str, list[str]], terms: bool = False) -> tuple[DataFrame, str]:
        """The result of a query call, and the format its path names, if any."""
        if head == "api":
            code, name, form = parse_call(f"api/{rest}")
            t = self._template(code, name)
            return self.engine.query(t.expand(args), t.repo, terms), form
        if head != "repo" or not args.get("query", [""])[0]:
            raise SparqlError("no query")
        return self.engine.query(args["query"][0], rest.replace("/", "_"), terms), ""

    def _route(self, path: str) -> tuple[int, str, Iterator[str], float]:
        head, rest, args = self._split(path)
        first = lambda k: args.get(k, [None])[0]
        plain = lambda status, media, *texts: (status, media, iter(texts), self.timeout)
        if head in ("repo", "page") and (first("for-type") or first("for-pubkey")):
            name = listing.repo_for(first("for-type"), first("for-pubkey"))
            return plain(301, "text/plain", f"/{head}/{name.replace('_', '/', 1)}")
        if head == "repo" and rest or head == "api":
            return self._answer(head, rest, args)
        if head in ("openapi", "grlc-spec"):
            parts = rest.removeprefix("spec/").split("/")
            if len(parts) != 2:
                raise TemplateError(f"not a query: {rest}")
            t = self._template(*parts)
            return plain(200, "application/yaml", t.openapi()) if head == "openapi" else plain(200, "text/plain", grlc_text(t))
        if head in ("pubkeys", "types") and self.shards is not None:
            rows = listing.repos(self.shards).where(F.col("repo").startswith(head.removesuffix("s") + "_"))
            return 200, "text/plain", lines(rows), self.timeout
        if head in ("spaces", "spaces.json") and self.spaces is not None:
            js = head.endswith("json")
            rows = (listing.spaces_json if js else listing.spaces_html)(self.spaces)
            return 200, "application/json" if js else "text/html", _between(rows, *(("[", ",", "]") if js else ("<table>", "", "</table>"))), self.timeout
        if head == "metrics":
            return plain(200, "text/plain", metrics_text({k: f() for k, f in self.gauges.items()}))
        if head == "":
            links = ["/pubkeys", "/types", "/spaces", "/metrics", *(f"/page/{r}" for r in ("meta", "full", "text"))]
            return plain(200, "text/html", _page("Repositories and queries", links + [f"/openapi/{c}/{n}" for c, n in sorted(self.templates)]))
        if head in ("page", "tools") and rest:
            repo = rest.removesuffix("/yasgui.html").replace("/", "_")
            return plain(200, "text/html", _page(repo, [f"/repo/{rest.removesuffix('/yasgui.html')}?query="], "<form action='/repo/" + quote(rest.removesuffix("/yasgui.html")) + "'><textarea name='query'></textarea><button>ask</button></form>" if head == "tools" else ""))
        return plain(404, "text/plain", f"nothing at {quote(urlsplit(path).path)}")

    def _template(self, code: str, name: str) -> Template:
        if (code, name) not in self.templates:
            raise TemplateError(f"no query {code}/{name}")
        return self.templates[code, name]

    def _answer(self, head: str, rest: str, args: dict[str, list[str]]) -> tuple[int, str, Iterator[str], float]:
        first = lambda k: args.get(k, [None])[0]
        seconds = float(first("timeout") or self.timeout) if head == "repo" else self.timeout
        df, form = self._asked(head, rest, args, True)
        graph = df.columns == ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
        form = first("format") or form or ("nt" if graph else "json") if head == "repo" else form
        if graph and form in GRAPH_MEDIA:
            return 200, GRAPH_MEDIA[form], lines(triple_lines(df)), seconds
        if form not in MEDIA:
            raise TemplateError(f"no format {form}")
        if form == "csv":
            return 200, MEDIA[form], csv_chunks(_texts(self._asked(head, rest, args)[0])), seconds
        return 200, MEDIA[form], _json(df) if form == "json" else srx_chunks(df), seconds


def _page(title: str, links: list[str], more: str = "") -> str:
    items = "".join(f"<li><a href='{html.escape(x, quote=True)}'>{html.escape(x)}</a></li>" for x in links)
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{items}</ul>{more}</body></html>"


def _between(rows: DataFrame, start: str, mark: str, end: str) -> Iterator[str]:
    yield start
    for k, r in enumerate(rows.toLocalIterator()):
        yield (mark if k else "") + r[0]
    yield end


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string") for c in df.columns))


def _json(df: DataFrame) -> Iterator[str]:
    if df.columns == ["answer"] and df.dtypes[0][1] == "boolean":
        return iter([json.dumps({"head": {}, "boolean": df.first()[0]})])
    if all(t.startswith("struct") for _, t in df.dtypes):
        return json_chunks(df)
    return _between(to_json_rows(df), "[", ",", "]")


def grlc_text(t: Template) -> str:
    """The query with its description and parameters as comments."""
    lines = [f"#+ summary: {t.label or t.name}", f"#+ description: {t.description}", f"#+ endpoint: /repo/{t.repo}"]
    lines += [f"#+ parameter: {p.name}{' (optional)' if p.optional else ''}{' (several)' if p.multi else ''}" for p in t.parameters]
    return "\n".join([*lines, "", t.sparql]) + "\n"
