"""Published query templates: parameters, expansion, versions, descriptions, and results in several formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from quadrille.functions.text import ARTIFACT_CODE
from quadrille.model import ns
from quadrille.sparql.engine import Engine
from quadrille.sparql.parser import SparqlError

#: Strings, IRIs and comments, which hold no placeholders; VALUES clauses without rows over one; placeholders.
_PIECES = re.compile(
    r'''(?P<plain>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|\'{3}(?:[^\'\\]|\\.|\'(?!\'\'))*\'{3}|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|<[^<>"{}|^`\\\s]*>|\#[^\n]*)
    |\b(?i:values)\s*[?$](?P<over>_{1,2}[A-Za-z]\w*)\s*\{\s*\}(?P<dot>\s*\.)?
    |[?$](?P<at>_{1,2}[A-Za-z]\w*)''',
    re.S | re.X,
)


class TemplateError(ValueError):
    """A template call that cannot be answered: code 400 for the caller's fault."""

    code = 400


@dataclass(frozen=True)
class Parameter:
    name: str
    variable: str
    optional: bool
    iri: bool
    multi: bool


def parameter(variable: str) -> Parameter:
    """?_x is mandatory, ?__x optional; endings _iri, _multi and _multi_iri tell the kind of value."""
    optional = variable.startswith("__")
    name = variable.lstrip("_")
    iri = name.endswith("_iri")
    name = name.removesuffix("_iri")
    multi = name.endswith("_multi")
    return Parameter(name.removesuffix("_multi"), variable, optional, iri, multi)


def literal(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def iri(value: str) -> str:
    if re.search(r'[\x00-\x20<>"{}|^`\\]', value) or ":" not in value:
        raise TemplateError(f"not an IRI: {value!r}")
    return f"<{value}>"


@dataclass
class Template:
    """A query with placeholders, published in a nanopub and to be run on the repository ``repo``."""

    code: str
    name: str
    sparql: str
    repo: str = "full"
    label: str = ""
    description: str = ""

    @property
    def parameters(self) -> list[Parameter]:
        found = (m["over"] or m["at"] for m in _PIECES.finditer(self.sparql))
        return [parameter(v) for v in dict.fromkeys(v for v in found if v)]

    def expand(self, values: dict[str, list[str] | str]) -> str:
        """The query with its parameters filled in. A missing mandatory one is an error; an optional one that is not
        given stays a variable, and a VALUES clause over it is dropped. The text is gone through once, so that nothing
        in a value is taken for a placeholder, and nothing in a string, an IRI or a comment of the query either."""
        terms: dict[str, list[str]] = {}
        multi = {p.variable for p in self.parameters if p.multi}
        for p in self.parameters:
            given = values.get(p.name)
            given = [given] if isinstance(given, str) else list(given or [])
            if not given and not p.optional:
                raise TemplateError(f"missing parameter: {p.name}")
            if len(given) > 1 and not p.multi:
                raise TemplateError(f"one value only: {p.name}")
            if given:
                terms[p.variable] = [iri(v) if p.iri else literal(v) for v in given]

        def fill(m: re.Match) -> str:
            if m["over"]:
                return f"VALUES ?{m['over']} {{ {' '.join(terms[m['over']])} }}{m['dot'] or ''}" if m["over"] in terms else ""
            return terms[m["at"]][0] if m["at"] in terms and m["at"] not in multi else m[0]

        return _PIECES.sub(fill, self.sparql)

    def run(self, engine: Engine, values: dict[str, list[str] | str]) -> DataFrame:
        try:
            return engine.query(self.expand(values), self.repo)
        except SparqlError as e:
            raise TemplateError(str(e)) from e

    def openapi(self) -> str:
        """An OpenAPI description of the call, as YAML."""
        q = json.dumps
        lines = ["openapi: 3.0.4", "info:", f"  title: {q(self.label or self.name)}", f"  description: {q(self.description)}", f"  version: {q(self.code)}", "servers:", "  - url: /api", "paths:", f"  /{self.code}/{self.name}.{{format}}:", "    get:", f"      description: {q(self.description)}", "      parameters:"]
        lines += ["        - name: format", "          in: path", "          required: true", "          schema: {type: string, enum: [csv, json, srx]}"]
        for p in self.parameters:
            lines += [f"        - name: {p.name}", "          in: query", f"          required: {str(not p.optional).lower()}"]
            lines += ["          style: form", "          explode: true", "          schema: {type: array, items: {type: string}}"] if p.multi else ["          schema: {type: string}"]
        media = ["application/n-triples", "application/ld+json"] if re.search(r"(?i)\bconstruct\b", self.sparql) else ["text/csv", "application/json", "application/sparql-results+xml"]
        return "\n".join([*lines, "      responses:", "        '200':", "          description: result", "          content:", *(f"            {m}: {{}}" for m in media)]) + "\n"


def parse_call(path: str) -> tuple[str, str, str]:
    """Code, name and format of /api/<code>/<name>[.csv|.json|.srx]; csv if none is given."""
    m = re.fullmatch(rf"/?(?:api/)?({ARTIFACT_CODE})/([\w-]+?)(?:\.(csv|json|srx))?", path)
    if not m:
        raise TemplateError(f"not a query call: {path}")
    return m[1], m[2], m[3] or "csv"


def repo_of_endpoint(url: str, base: str) -> str:
    """The repository of an endpoint URL, which must start with the canonical base."""
    if not url.startswith(base):
        raise TemplateError(f"unknown endpoint: {url}")
    return url.removeprefix(base).strip("/").replace("/", "_")


def latest_version(engine: Engine, np: str) -> DataFrame:
    """The newest nanopub that supersedes this one, over any number of steps, was signed with the same key, and is not
    invalidated under it; the nanopub itself if there is none (one row: latest)."""
    q = f"""SELECT ?v ?date WHERE {{
  GRAPH <{ns("npa:graph")}> {{
    <{np}> <{ns("npa:hasValidSignatureForPublicKeyHash")}> ?key .
    ?v <{ns("npx:supersedes")}>* <{np}> .
    ?v <{ns("npa:hasValidSignatureForPublicKeyHash")}> ?key .
    ?v <{ns("dct:created")}> ?date .
    FILTER NOT EXISTS {{ ?i <{ns("npx:invalidates")}> ?v ; <{ns("npa:hasValidSignatureForPublicKeyHash")}> ?key . }}
  }} }} ORDER BY DESC(?date) LIMIT 1"""
    from pyspark.sql import functions as F

    return engine.query(q).agg(F.coalesce(F.first("v"), F.lit(np)).alias("latest"))


# -- results


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """A JSON object per row, without unbound variables."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def binding_xml(term: tuple | None) -> str:
    if term is None:
        return ""
    k, v, dt, lang = term
    if k == "iri":
        return f"<uri>{escape(v)}</uri>"
    if k == "bnode":
        return f"<bnode>{escape(v.removeprefix('_:'))}</bnode>"
    attr = f' xml:lang="{lang}"' if lang else "" if dt.endswith("#string") or not dt else f' datatype="{escape(dt)}"'
    return f"<literal{attr}>{escape(v)}</literal>"


def to_srx_rows(df: DataFrame) -> DataFrame:
    """A <result> element per row of a query asked with terms=True; nothing is gathered on the driver."""
    names = df.columns

    def rows(parts):
        for b in parts:
            yield b.apply(lambda r: "<result>" + "".join(f'<binding name="{n}">{binding_xml(tuple(r[n][c] for c in ("k", "v", "dt", "lang")) if r[n] is not None else None)}</binding>' for n in names if r[n] is not None) + "</result>", axis=1).to_frame("value")

    return df.mapInPandas(rows, "value string")


def srx_chunks(df: DataFrame) -> Iterator[str]:
    """A result document in pieces."""
    head = "".join(f'<variable name="{n}"/>' for n in df.columns)
    yield f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>'
    for r in to_srx_rows(df).toLocalIterator():
        yield r[0]
    yield "</results></sparql>"


def srx(df: DataFrame) -> str:
    """A whole result document, for results that fit the driver."""
    return "".join(srx_chunks(df))
