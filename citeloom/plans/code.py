"""Queries on code: sources written from the documents, cut by symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import chunking
from citeloom.plans.base import query
from citeloom.plans.text import CHUNK_COLUMNS
from citeloom.session import table


@query(
    "chunk_code",
    """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, E'\\n')) AS x, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS i FROM documents),
p AS (SELECT id, i, 'def f' || i::VARCHAR || E'():\\n    return ' || length(x)::VARCHAR AS piece FROM l),
q AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
SELECT id, 'm/' || id::VARCHAR || '.py' AS file_path, 'f' || i::VARCHAR AS symbol, NULL AS parent, 'python' AS language, s::INTEGER AS byte_start, (s + length(piece))::INTEGER AS byte_end, sha256(piece) AS content_hash FROM q""",
)
def chunk_code(spark, sf_dir):
    """Documents as Python modules of one function a line, cut by symbol."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    return "), F.length(x).cast("string")))
    f = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.array_join(lines, "\n").alias("content"))
    return chunking.symbols(f).select(*CHUNK_COLUMNS)


# A module around the text of a document, in pieces. {n} is its id, and {comment}, {within} and {child} are its text
# where it stands in a comment, in a template or between tags. A name opens a symbol's range and None closes it.
MODULE = (
    "import {{ a }} from 'lib';\n/* {comment} */\n",
    ("Api", None), "export interface Api {{\n  get(a: string): {{ b: number }};\n}}", None,
    "\n",
    ("Store", None), "@dec({{ of: '}}' }})\nexport class Store<T = {{}}> extends Base {{\n  private text = `{within}`;\n  ",
    ("read", "Store"), "public async read(key: string): Promise<string> {{\n    return `${{this.text + `{within}`}} }} ${{key ? '}}' : \"{{\"}}`; // it's {n}\n  }}", None,
    "\n  over(a: string): void;\n  ",
    ("size", "Store"), "get size(): number {{\n    return /[}}/`]/.test(`{within}`) ? 1 / 2 : 0;\n  }}", None,
    "\n}}", None,
    "\nabstract class Shape {{\n  ", ("area", None), "area() {{ return {n} }}", None, "\n}}\n",
    ("load", None), "export default async function load<T>(a: T): Promise<{{ of: T }}> {{\n  const inner = ",
    ("inner", None), "(x: string) => x + `{within}`", None,
    ", other = 1;\n  return {{ of: a }};\n}}", None,
    "\nexport const half: (a: number) => number = ",
)
PLAIN = (("half", None), "(a) => {{\n  return a / {n} / 2;\n}}", None, "\n")
TAGGED = (("half", None), "(a) => <p title=\"it's {{\">{child} {{`{within}`}} <b on={{() => {n}}}/></p>", None, "\n")
_CUTS = (("comment", "[*]/", ""), ("within", "[`$\\\\]", ""), ("child", "[{}<>]", ""))


def _sql_of(pieces: tuple) -> str:
    """(symbol, parent, s, body) rows of a module as SQL, and its offsets by lengths alone."""
    texts = [p for p in pieces if isinstance(p, str)]
    written = [_piece(t) for t in texts]
    rows, held, at = [], [], 0
    for p in pieces:
        if isinstance(p, str):
            at += 1
        elif p:
            held.append((*p, at))
        else:
            name, parent, begin = held.pop()
            before = " + ".join(f"length(p{k})" for k in range(begin)) or "0"
            rows.append(f"{{symbol: '{name}', parent: {f"'{parent}'" if parent else 'NULL'}, s: {before}, body: {' || '.join(f'p{k}' for k in range(begin, at))}}}")
    return f"SELECT id, path, unnest([{', '.join(rows)}]) AS r FROM (SELECT id, path, {', '.join(f'{w} AS p{k}' for k, w in enumerate(written))} FROM d)"


def _piece(text: str) -> str:
    """A piece as an SQL expression over n, comment, within and child."""
    text = text.replace("'", "''").replace("\n", "' || chr(10) || '")
    for name in ("n", "comment", "within", "child"):
        text = text.replace("{%s}" % name, f"' || {name} || '")
    return "'" + text.replace("{{", "{").replace("}}", "}") + "'"


@query(
    "chunk_typescript",
    f"""WITH d AS (SELECT doc_id AS id, 'm/' || doc_id::VARCHAR || CASE doc_id % 2 WHEN 0 THEN '.ts' ELSE '.TSX' END AS path, doc_id::VARCHAR AS n,
 {", ".join(f"regexp_replace(text, '{cut}', '{by}', 'g') AS {name}" for name, cut, by in _CUTS)} FROM documents),
r AS (SELECT * FROM ({_sql_of(MODULE + PLAIN)}) WHERE id % 2 = 0 UNION ALL SELECT * FROM ({_sql_of(MODULE + TAGGED)}) WHERE id % 2 <> 0)
SELECT id, path AS file_path, r.symbol AS symbol, r.parent AS parent, 'typescript' AS language, r.s::INTEGER AS byte_start, (r.s + length(r.body))::INTEGER AS byte_end, sha256(r.body) AS content_hash FROM r""",
)
def chunk_typescript(spark, sf_dir):
    """Every document within a module of classes, functions, templates and tags, cut by symbol."""
    names = {name: F.regexp_replace("text", cut, by) for name, cut, by in _CUTS}
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("n"), *[c.alias(k) for k, c in names.items()])

    def module(pieces: tuple):
        """The concatenated texts of the pieces, with the document's values in their places."""
        out = []
        for piece in (p for p in pieces if isinstance(p, str)):
            rest = piece
            while rest:
                found = sorted((rest.index("{%s}" % k), k) for k in ("n", "comment", "within", "child") if "{%s}" % k in rest)
                at, name = found[0] if found else (len(rest), None)
                out.append(F.lit(rest[:at].replace("{{", "{").replace("}}", "}")))
                if name:
                    out.append(F.col(name))
                rest = rest[at + len(name) + 2 :] if name else ""
        return F.concat(*out)

    even = F.col("id") % 2 == 0
    path = F.concat(F.lit("m/"), "n", F.when(even, ".ts").otherwise(".TSX"))
    f = d.select("id", path.alias("file_path"), F.when(even, module(MODULE + PLAIN)).otherwise(module(MODULE + TAGGED)).alias("content"))
    return chunking.symbols(f).select(*CHUNK_COLUMNS)
