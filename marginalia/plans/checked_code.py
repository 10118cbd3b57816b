"""Checked queries: code entities and their chunks.

The files are made of the documents: one class (or struct with its impl) per document, one method
per line of its text, the line itself as a comment in the body. What must be found follows from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.entities import extract_entities, file_outline
from marginalia.operators.entity_chunks import (
    attach_parent,
    chunk_entities,
    chunking_stats,
    entity_type_counts,
    file_summary,
    flatten_file_chunks,
)
from marginalia.plans.catalog import checked
from marginalia.plans.checked_chunks import PACK_SQL
from marginalia.plans.derived import texts
from marginalia.session import write_once

_LINES_SQL = """
docs as (
  select doc_id, source, lang, list_transform(string_split(text, chr(10)), lambda x: replace(x, chr(13), '')) as l from documents)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.replace(x, F.lit("\r"), F.lit("")))
    return texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("n"), "source", "lang", lines.alias("l"))


_TS_METHOD = "'  m' || i || '(a: string): string {' || chr(10) || '    // ' || x || chr(10) || '    return a;' || chr(10) || '  }'"
_TS_SQL = f"""
{_LINES_SQL},
ts as (
  select doc_id, source, lang, l, len(l) as n, source || '/c' || doc_id || '.ts' as filepath,
    list_transform(l, lambda x, i: {_TS_METHOD}) as methods
  from docs),
ts_files as (
  select *, 'export class C' || doc_id || ' {{' || chr(10) || array_to_string(methods, chr(10)) || chr(10) || '}}' as class_code from ts),
ts_entities as (
  select filepath, 0 as entity_no, 'class' as entity_type, 'C' || doc_id as name, 'C' || doc_id as qualified_name, class_code as code,
    null::varchar as parent_context, 4 as start_line, 5 + 4 * n as end_line, '/** {{ ' || lang || ' */' as doc, null::varchar as parameters, null::varchar as return_type
  from ts_files
  union all
  select filepath, i, 'method', 'm' || i, 'C' || doc_id || '.m' || i, trim(methods[i]), 'C' || doc_id, 1 + 4 * i, 4 + 4 * i, null, '(a: string)', 'string'
  from (select *, unnest(range(1, n + 1)) as i from ts_files))
"""


def _ts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = lambda x, i: F.concat(
        F.lit("  m"), (i + 1).cast("string"), F.lit("(a: string): string {\n    // "), x, F.lit("\n    return a;\n  }")
    )
    return _lines(spark, sf_dir).select(
        F.concat("source", F.lit("/c"), "n", F.lit(".ts")).alias("filepath"),
        F.concat(
            F.lit('import { x } from "./'),
            "source",
            F.lit('";\n\n/** { '),
            "lang",
            F.lit(" */\nexport class C"),
            "n",
            F.lit(" {\n"),
            F.array_join(F.transform("l", method), "\n"),
            F.lit("\n}\n"),
        ).alias("content"),
    )


_SHOWN = [
    "filepath",
    "entity_no",
    "entity_type",
    "name",
    "qualified_name",
    "code",
    "parent_context",
    "start_line",
    "end_line",
    "is_exported",
    "doc",
    "parameters",
    "return_type",
]


@checked(
    f"""with {_TS_SQL} select filepath, entity_no::integer as entity_no, entity_type, name, qualified_name, code, parent_context,
      start_line::integer as start_line, end_line::integer as end_line, true as is_exported, doc, parameters, return_type from ts_entities"""
)
def typescript_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(_ts_files(spark, sf_dir)).select(*_SHOWN)


@checked(
    f"""with {_LINES_SQL},
    rs as (
      select doc_id, source, lang, len(l) as n, source || '/s' || doc_id || '.rs' as filepath, 's' || doc_id as module,
        list_transform(l, lambda x, i: '    pub fn f' || i || '(&self, a: u8) -> u8 {{' || chr(10) || '        // ' || x || chr(10) || '        a' || chr(10) || '    }}') as fns
      from docs)
    select * replace (entity_no::integer as entity_no, start_line::integer as start_line, end_line::integer as end_line, doc::varchar as doc) from (
    select filepath, 0::integer as entity_no, 'struct' as entity_type, 'S' || doc_id as name, module || '::S' || doc_id as qualified_name,
      'pub struct S' || doc_id || ' {{' || chr(10) || '    a: u8,' || chr(10) || '}}' as code, null as parent_context,
      5::integer as start_line, 7::integer as end_line, true as is_exported, 'about ' || lang as doc, null as parameters, null as return_type
    from rs
    union all
    select filepath, 1, 'impl', 'S' || doc_id, module || '::S' || doc_id,
      'impl S' || doc_id || ' {{' || chr(10) || array_to_string(fns, chr(10)) || chr(10) || '}}', null, 9, 10 + 4 * n, false, null, null, null from rs
    union all
    select filepath, 1 + i, 'function', 'f' || i, module || '::S' || doc_id || '::f' || i, fns[i], 'S' || doc_id,
      6 + 4 * i, 9 + 4 * i, true, null, '(&self, a: u8)', 'u8'
    from (select *, unnest(range(1, n + 1)) as i from rs))"""
)
def rust_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(_rust_files(spark, sf_dir)).select(*_SHOWN)


def _rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = lambda x, i: F.concat(
        F.lit("    pub fn f"), (i + 1).cast("string"), F.lit("(&self, a: u8) -> u8 {\n        // "), x, F.lit("\n        a\n    }")
    )
    return _lines(spark, sf_dir).select(
        F.concat("source", F.lit("/s"), "n", F.lit(".rs")).alias("filepath"),
        F.concat(
            F.lit("//! "),
            "source",
            F.lit("\nuse std::x;\n\n/// about "),
            "lang",
            F.lit("\npub struct S"),
            "n",
            F.lit(" {\n    a: u8,\n}\n\nimpl S"),
            "n",
            F.lit(" {\n"),
            F.array_join(F.transform("l", fn), "\n"),
            F.lit("\n}\n"),
        ).alias("content"),
    )


@checked(
    f"""with {_LINES_SQL},
    py as (
      select doc_id, lang, len(l) as n, source || '/p' || doc_id || '.py' as filepath, 'p' || doc_id as module,
        list_transform(l, lambda x, i: '    def m' || i || '(self, a=1) -> int:' || chr(10) || '        # ' || x || chr(10) || '        return a') as defs
      from docs)
    select * replace (entity_no::integer as entity_no, start_line::integer as start_line, end_line::integer as end_line, doc::varchar as doc) from (
    select filepath, 0::integer as entity_no, 'class' as entity_type, 'P' || doc_id as name, module || '.P' || doc_id as qualified_name,
      'class P' || doc_id || ':' || chr(10) || '    "" "' || lang || '" ""' || chr(10) || array_to_string(defs, chr(10)) as code,
      null as parent_context, 2::integer as start_line, (3 + 3 * n)::integer as end_line, false as is_exported, null as doc, null as parameters, null as return_type
    from py
    union all
    select filepath, i, 'method', 'm' || i, module || '.P' || doc_id || '.m' || i, defs[i], 'P' || doc_id, 1 + 3 * i, 3 + 3 * i, false, null, '(self, a=1)', 'int'
    from (select *, unnest(range(1, n + 1)) as i from py))""".replace('"" "', '_ = "').replace('" ""', '"')
)
def python_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = lambda x, i: F.concat(
        F.lit("    def m"), (i + 1).cast("string"), F.lit("(self, a=1) -> int:\n        # "), x, F.lit("\n        return a")
    )
    files = _lines(spark, sf_dir).select(
        F.concat("source", F.lit("/p"), "n", F.lit(".py")).alias("filepath"),
        F.concat(
            F.lit("import os\nclass P"),
            "n",
            F.lit(':\n    _ = "'),
            "lang",
            F.lit('"\n'),
            F.array_join(F.transform("l", method), "\n"),
        ).alias("content"),
    )
    return extract_entities(files).select(*_SHOWN)


LIMIT = 100
_CHUNKS_SQL = f"""
{_TS_SQL},
headed as (
  select *, '// Entity: ' || qualified_name || chr(10) || '// ' || entity_type || chr(10) || '// ... (continued)' || chr(10) as header from ts_entities),
texts as (
  select {{'f': filepath, 'e': entity_no}} as key, qualified_name as chunk_title, code as text, {LIMIT} as total,
    {LIMIT} - ceil(length(header) / 4.0)::bigint as lim from headed),
{PACK_SQL},
counted as (select key, count(*) as total from parts group by key having count(*) > 1),
entity_parts as (
  select h.filepath, h.entity_no, p.part, h.qualified_name || '_part' || (p.part + 1) as qualified_name, h.qualified_name as base_name, h.entity_type,
    header || p.text as content, start_line + p.first as start_line, start_line + p.last as end_line, h.doc, p.part + 1 as part_number, c.total as total_parts
  from parts p join counted c using (key) join headed h on h.filepath = p.key.f and h.entity_no = p.key.e
  union all
  select filepath, entity_no, 0, qualified_name, qualified_name, entity_type, code, start_line, end_line, doc, null, null
  from headed where {{'f': filepath, 'e': entity_no}} not in (select key from counted))
"""


@checked(
    f"""with recursive {_CHUNKS_SQL}
    select filepath, (row_number() over (partition by filepath order by entity_no, part) - 1)::integer as chunk_index, qualified_name, base_name,
      entity_type, content, sha256(content) as checksum, start_line::integer as start_line, end_line::integer as end_line,
      case when part = 0 then doc end as doc, part_number::integer as part_number, total_parts::integer as total_parts
    from entity_parts"""
)
def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_entities(extract_entities(_ts_files(spark, sf_dir)), LIMIT).select(
        "filepath",
        "chunk_index",
        "qualified_name",
        "base_name",
        "entity_type",
        "content",
        "checksum",
        "start_line",
        "end_line",
        "doc",
        "part_number",
        "total_parts",
    )


@checked(
    f"""with recursive {_CHUNKS_SQL}
    select (select count(*) from documents) as files, (select count(*) from ts_entities) as entities, (select count(*) from entity_parts) as chunks,
      (select count(*) from counted) as split_entities,
      (select count(*) from entity_parts)::double / (select count(*) from documents) as chunks_per_file"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ts_files(spark, sf_dir)
    return chunking_stats(chunk_entities(extract_entities(files), LIMIT), files)


@checked(
    f"""with {_LINES_SQL} select 'class' as entity_type, 2 * count(*) as chunks from docs
    union all select 'function', sum(len(l))::bigint from docs"""
)
def unified_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_type_counts(chunk_entities(extract_entities(_rust_files(spark, sf_dir)), 1_000_000))


@checked(
    f"""with {_TS_SQL}
    select filepath, 'Imports:' || chr(10) || '  import {{ x }} from "./' || source || '";' || chr(10) || chr(10) || 'Classs:' || chr(10) || '  export C' || doc_id
      || chr(10) || chr(10) || 'Methods:' || chr(10)
      || array_to_string(list_transform(range(1, n + 1), lambda i: '  export C' || doc_id || '.m' || i || '(a: string): string'), chr(10)) as summary
    from ts_files"""
)
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ts_files(spark, sf_dir)
    return file_summary(extract_entities(files), file_outline(files))


@checked(
    f"""with recursive {_CHUNKS_SQL}, files_ as (select filepath, source, lang from ts)
    select p.filepath, qualified_name, 'import {{ x }} from "./' || source || '";' as imports, '/** {{ ' || lang || ' */' as module_doc
    from entity_parts p join files_ using (filepath)"""
)
def chunks_with_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ts_files(spark, sf_dir)
    flat = flatten_file_chunks(chunk_entities(extract_entities(files), LIMIT), file_outline(files))
    return flat.select("filepath", "qualified_name", F.array_join("imports", "\n").alias("imports"), "module_doc")


@checked(
    f"""with recursive {_CHUNKS_SQL}
    select p.filepath, p.qualified_name, e.name as entity_name, e.parameters, length('import {{ x }} from "./' || f.source || '";' || '/** {{ ' || f.lang || ' */' || f.class_code) + 4 as document_length
    from entity_parts p join ts_entities e on e.filepath = p.filepath and e.entity_no = p.entity_no join ts_files f on f.filepath = p.filepath"""
)
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ts_files(spark, sf_dir)
    # Files are scanned once, and a document is measured once, not for each of its chunks.
    entities = write_once(extract_entities(files))
    measured = files.withColumn("document_length", F.length("content").cast("long"))
    parents = attach_parent(chunk_entities(entities, LIMIT), entities, measured)
    return parents.select("filepath", "qualified_name", "entity_name", "parameters", "document_length")


# Ordinary code that misleads a careless reader: quotes and brackets in regular expressions, nested
# templates, apostrophes in markup, bodies on one line. `@body` is where a document's lines stand as
# comments, `@n` its id. Expected entities: (type, name, parent, first line, last line, exported), lines
# counted without the document's lines, which stand inside the entity named first.
_TS_BODY = 4
_TS_ORDINARY = r'''/** Doc of f@n */
export async function f@n(s: string): Promise<string> {
  const quoted = s.replace(/"/g, "x").replace(/[{'`]/g, `a ${s ? `b}` : ""} c`);
@body
  return quoted / 2 / 3;
}
export interface I@n { a: string; b(): void }
export type T@n =
  | { a: string }
  | { b: number };
export const enum E@n { A, B }
export const arrow@n = (a: string): string => {
  return <p title="it's">Don't { a } http://x</p>;
}
const hidden@n: number = 3;
@injected({ a: 1 })
export default class C@n<T> extends f@n {
  constructor(private a: string) { super(); }
  static async go(b: { c: string }): Promise<void> { if (b) { this.a = "}"; } }
}
'''
_TS_EXPECTED = (
    ("function", "f", None, 2, 6, True),
    ("interface", "I", None, 7, 7, True),
    ("type", "T", None, 8, 10, True),
    ("enum", "E", None, 11, 11, True),
    ("function", "arrow", None, 12, 14, True),
    ("variable", "hidden", None, 15, 15, False),
    ("class", "C", None, 17, 20, True),
    ("method", "constructor", "C", 18, 18, True),
    ("method", "go", "C", 19, 19, True),
)
_RS_BODY = 2
_RS_ORDINARY = r'''pub unsafe fn free@n<'a>(s: &'a str) -> char {
@body
    if s == "}" { '{' } else { '\'' } /* { /* } */ */
}
pub trait Shape@n { const N@n: u8; type Out@n; fn area@n(&self) -> f64; }
pub enum Kind@n { A@n, B@n(u8, u16), C@n { x: i32 } }
#[derive(Debug)]
pub struct S@n<'a> { x: &'a str }
impl<'a, T: Into<String>> Shape@n for S@n<'a>
where T: Clone {
    fn raw@n(&self) { let s = r#"}""#; }
}
macro_rules! mac@n { ($x:expr) => { $x }; }
pub const CONST@n: u8 = 1;
static mut STATIC@n: &str = "}";
pub type Alias@n = Vec<u8>;
mod inner@n { fn hidden() {} }
pub union U@n { a: u8 }
'''
_RS_EXPECTED = (
    ("function", "free", None, 1, 4, True),
    ("trait", "Shape", None, 5, 5, True),
    ("associated_const", "N", "Shape", 5, 5, False),
    ("associated_type", "Out", "Shape", 5, 5, False),
    ("function", "area", "Shape", 5, 5, False),
    ("enum", "Kind", None, 6, 6, True),
    ("enum_variant", "A", None, 6, 6, True),
    ("enum_variant", "B", None, 6, 6, True),
    ("enum_variant", "C", None, 6, 6, True),
    ("struct", "S", None, 8, 8, True),
    ("impl", "S@n::Shape", None, 9, 12, False),
    ("function", "raw", "S", 11, 11, False),
    ("macro", "mac", None, 13, 13, False),
    ("const", "CONST", None, 14, 14, True),
    ("static", "STATIC", None, 15, 15, False),
    ("type_alias", "Alias", None, 16, 16, True),
    ("mod", "inner", None, 17, 17, False),
    ("union", "U", None, 18, 18, True),
)
_PY_BODY = 4
_PY_ORDINARY = r'''import os
@decorated(a={"b": 1})
async def f@n(s: str) -> str:
@body
    return "def no(): {"
class C@n(f@n):
    @property
    def p@n(self): return [x for x in "}"]
if os:
    def late@n(): pass
'''
_PY_EXPECTED = (
    ("function", "f", None, 2, 5, False),
    ("class", "C", None, 6, 8, False),
    ("method", "p", "C", 7, 8, False),
    ("function", "late", None, 10, 10, False),
)


def _ordinary_files(spark: SparkSession, sf_dir: str, template: str, ending: str, comment: str):
    before, after = template.split("@body")
    fill = lambda part: F.replace(F.lit(part), F.lit("@n"), F.col("n"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit(comment), x)), "\n")
    return _lines(spark, sf_dir).select(
        F.concat("source", F.lit("/o"), "n", F.lit(ending)).alias("filepath"),
        F.concat(fill(before), body, fill(after)).alias("content"),
    )


def _ordinary_sql(expected: tuple, body: int, ending: str) -> str:
    """The body takes one line of the template; the lines of the document come in its place."""
    named = lambda name: "null" if name is None else f"'{name}' || " + "doc_id"
    parts = []
    for number, (kind, name, parent, first, last, exported) in enumerate(expected):
        shown = f"replace('{name}', '@n', doc_id::varchar)" if "@n" in name else None
        shown = f"{shown} || doc_id" if shown else f"'{name}'" if name in ("constructor", "go") else named(name)
        move = lambda line: f"{line} + case when {line} > {body} then n - 1 else 0 end"
        parts.append(
            f"select filepath, {number}::integer as entity_no, '{kind}' as entity_type, {shown} as name, "
            f"{named(parent)} as parent_context, ({move(first)})::integer as start_line, "
            f"({move(last)})::integer as end_line, {str(exported).lower()} as is_exported, true as is_balanced from o"
        )
    return (
        f"with {_LINES_SQL}, o as (select doc_id, len(l) as n, source || '/o' || doc_id || '{ending}' as filepath from docs) "
        + " union all ".join(parts)
    )


_ORDINARY_SHOWN = [
    "filepath", "entity_no", "entity_type", "name", "parent_context", "start_line", "end_line", "is_exported",
    "is_balanced",
]


@checked(_ordinary_sql(_TS_EXPECTED, _TS_BODY, ".tsx"))
def ordinary_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _ordinary_files(spark, sf_dir, _TS_ORDINARY, ".tsx", "  // ")
    return extract_entities(files, variables=True).select(*_ORDINARY_SHOWN)


@checked(_ordinary_sql(_RS_EXPECTED, _RS_BODY, ".rs"))
def ordinary_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(_ordinary_files(spark, sf_dir, _RS_ORDINARY, ".rs", "    // ")).select(*_ORDINARY_SHOWN)


@checked(_ordinary_sql(_PY_EXPECTED, _PY_BODY, ".py"))
def ordinary_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(_ordinary_files(spark, sf_dir, _PY_ORDINARY, ".py", "    # ")).select(*_ORDINARY_SHOWN)


@checked(
    f"""with {_LINES_SQL}, o as (
      select doc_id, source, array_to_string(list_transform(l, lambda x: '// ' || x), chr(10)) as body,
        array_to_string(list_transform(l, lambda x: '# ' || x), chr(10)) as hashed, len(l) as n from docs)
    select source || '/u' || doc_id || '.ts' as filepath, 'module' as entity_type, 'u' || doc_id as name,
      'function a() {{' || chr(10) || body as code, 1::integer as start_line, (1 + n)::integer as end_line, false as is_balanced from o
    union all
    select source || '/u' || doc_id || '.py', 'module', 'u' || doc_id, 'x = 1' || chr(10) || hashed, 1,
      (1 + n)::integer, true from o"""
)
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose brackets do not match, and files without a declaration."""
    body = lambda mark: F.array_join(F.transform("l", lambda x: F.concat(F.lit(mark), x)), "\n")
    path = lambda ending: F.concat("source", F.lit("/u"), "n", F.lit(ending)).alias("filepath")
    lines = _lines(spark, sf_dir)
    open_ended = lines.select(path(".ts"), F.concat(F.lit("function a() {\n"), body("// ")).alias("content"))
    plain = lines.select(path(".py"), F.concat(F.lit("x = 1\n"), body("# ")).alias("content"))
    return extract_entities(open_ended.unionByName(plain)).select(
        "filepath", "entity_type", "name", "code", "start_line", "end_line", "is_balanced"
    )
