"""Code entities of TypeScript, Rust and Python files.

A file is one row and is read in one pass inside a task; nothing is shuffled. TypeScript and Rust: a
scanner blanks what is no code and follows the bracket depth; declarations are found by pattern at the
depth where they may stand, and an entity ends where its depth is reached again. This reads layout,
not grammar. Where brackets do not match, the file is one entity as a whole, marked as not balanced.
Python files are parsed by the standard library.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.functions.paths import CODE_ENDINGS, document_type
from marginalia.functions.text import content_checksum, trim_space
from marginalia.operators.code_scan import blank_rust, blank_typescript, ends, pieces
from marginalia.schema import ENTITY

_NAME = "([A-Za-z_$][\\w$]*)"
#: Entities, and characters of their code, that a task holds before it hands them on.
MOST_ROWS = 2000
MOST_CHARS = 2_000_000


@dataclass(frozen=True)
class Declaration:
    """A pattern at the start of a line; group 1 is the export mark, group 2 the name."""

    entity_type: str
    pattern: str


@dataclass(frozen=True)
class Language:
    """How one language declares entities: at the top, and inside which owners."""

    separator: str
    module_type: str
    module_when_empty: bool
    prefix_module: bool
    blank: Callable[[str], str]
    continued: str
    goes_on: str
    top: tuple[Declaration, ...]
    members: tuple[tuple[str, Declaration], ...]
    imports: str
    block_docs: bool


_EXPORT = "\\s*(export\\s+)?(?:default\\s+)?(?:declare\\s+)?"
_PUB = "\\s*(pub(?:\\([^)]*\\))?\\s+)?"
_FN = "(?:(?:default|const|async|unsafe|extern)\\s+(?:\\s+)?)*fn\\s+"
_NOT_CONTROL = (
    "(?!(?:if|for|while|switch|catch|return|function|super|await|throw|new)\\b|(?:get|set)\\s+[\\w$#])"
)

TYPESCRIPT = Language(
    separator=".",
    module_type="module",
    module_when_empty=False,
    prefix_module=False,
    blank=blank_typescript,
    continued="extends\\b|implements\\b|[^\\w$]",
    goes_on="[|&?:.,=)({]|=>|else\\b|catch\\b|finally\\b|while\\b|as\\b|satisfies\\b",
    top=(
        Declaration("function", f"{_EXPORT}(?:async\\s+)?function\\s*\\*?\\s*{_NAME}"),
        Declaration("class", f"{_EXPORT}(?:abstract\\s+)?class\\s+{_NAME}"),
        Declaration("interface", f"{_EXPORT}interface\\s+{_NAME}"),
        Declaration("type", f"{_EXPORT}type\\s+{_NAME}"),
        Declaration("enum", f"{_EXPORT}(?:const\\s+)?enum\\s+{_NAME}"),
        Declaration("variable", f"{_EXPORT}(?:const|let|var)\\s+{_NAME}"),
    ),
    members=(
        (
            "class",
            Declaration(
                "method",
                "()\\s*(?:(?:public|private|protected|static|async|override|abstract)\\s+)*\\*?\\s*"
                f"{_NOT_CONTROL}(#?[A-Za-z_$][\\w$]*)\\s*\\??(?:<[^(]*>)?\\(",
            ),
        ),
    ),
    imports="(?m)^import\\b[^;]*?[\"'][^\"'\\n]*[\"'];?",
    block_docs=True,
)

RUST = Language(
    separator="::",
    module_type="mod",
    module_when_empty=True,
    prefix_module=True,
    blank=blank_rust,
    continued="where\\b|for\\b|[^\\w]",
    goes_on="[?.,=){]|else\\b|where\\b",
    top=(
        Declaration("function", f"{_PUB}{_FN}{_NAME}"),
        Declaration("struct", f"{_PUB}struct\\s+{_NAME}"),
        Declaration(
            "impl",
            "()\\s*(?:unsafe\\s+)?impl\\b(?:<[^{]*?>)?\\s+([^{]+?)\\s*(?:where\\b.*)?(?:\\{.*)?$",
        ),
        Declaration("trait", f"{_PUB}(?:unsafe\\s+)?trait\\s+{_NAME}"),
        Declaration("enum", f"{_PUB}enum\\s+{_NAME}"),
        Declaration("type_alias", f"{_PUB}type\\s+{_NAME}"),
        Declaration("const", f"{_PUB}const\\s+(?!fn\\b){_NAME}\\s*:"),
        Declaration("static", f"{_PUB}static\\s+(?:mut\\s+)?{_NAME}"),
        Declaration("macro", f"()\\s*macro_rules!\\s*{_NAME}"),
        Declaration("mod", f"{_PUB}mod\\s+{_NAME}"),
        Declaration("union", f"{_PUB}union\\s+{_NAME}"),
    ),
    members=(
        ("impl", Declaration("function", f"{_PUB}{_FN}{_NAME}")),
        ("trait", Declaration("function", f"{_PUB}{_FN}{_NAME}")),
        ("trait", Declaration("associated_type", f"{_PUB}type\\s+{_NAME}")),
        ("trait", Declaration("associated_const", f"{_PUB}const\\s+(?!fn\\b){_NAME}\\s*:")),
        ("enum", Declaration("enum_variant", "()\\s*([A-Z][\\w]*)\\s*(?:[({,=]|$)")),
    ),
    imports="(?m)^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?use\\s[^;]*;",
    block_docs=False,
)

LANGUAGES = {"typescript": TYPESCRIPT, "rust": RUST}


_MODULE_ENDING = re.compile(r"\.(?:py|rs|tsx?)\Z", re.I)

_GENERICS = re.compile(r"<[^<>]*>")
_LAST_NAME = re.compile(r"([A-Za-z_]\w*)\s*\Z")


def _last_name(text: str) -> str:
    found = _LAST_NAME.search(text)
    return found[1] if found else ""


def _whole_header(found: list, at: int) -> tuple[str, int]:
    """The pieces from ``at`` on up to the one that opens a body or ends the declaration, and where that is."""
    parts = [found[at].code]
    while not parts[-1].endswith(("{", ";")) and at + 1 < len(found):
        at += 1
        parts.append(found[at].code.strip())
    return " ".join(parts), at


def _impl_names(header: str) -> tuple[str, str]:
    """(type, shown name) of an impl header ``Trait for Type`` or ``Type``."""
    bare, before = re.sub(r"\bwhere\b.*", "", header, flags=re.S).replace("->", ""), None
    while bare != before:
        bare, before = _GENERICS.sub("", bare), bare
    trait, _, owner = bare.rpartition(" for ")
    owner, trait = _last_name(owner), _last_name(trait)
    return owner, f"{owner}::{trait}" if trait else owner


def _declared(code: str, declarations: Sequence[Declaration]) -> tuple[str, str, bool] | None:
    """(entity type, name, export mark) of the first declaration whose pattern starts the code."""
    for declaration in declarations:
        if found := re.match(declaration.pattern, code):
            return declaration.entity_type, found[2], bool(found[1])
    return None


_ARROW = re.compile(
    r"[^;{]*?=\s*(?:async\s*)?(?:<[^(]*>\s*)?(?:\([\s\S]*?\)|[\w$]+)\s*(?::[^=;{]+)?=>"
)
_TYPED = re.compile(r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+[\w$]+\s*:")


def _docs(lines: list[str], language: Language) -> Callable[[int], str | None]:
    """A function from the line of a declaration to the documentation above it.

    Attributes and decorators may stand between.
    """
    raw = [line.strip() for line in lines]
    opened, last = [0] * (len(raw) + 1), 0
    for i, line in enumerate(raw, 1):
        last = i if line.startswith("/**") else last
        opened[i] = last

    def above(start: int) -> str | None:
        end = start - 1
        while end and raw[end - 1].startswith(("@", "#[")):
            end -= 1
        if language.block_docs:
            if not end or not raw[end - 1].endswith("*/") or not opened[end]:
                return None
            return "\n".join(lines[opened[end] - 1 : end]).strip()
        first = end
        while first and (raw[first - 1].startswith("//") or not raw[first - 1]):
            first -= 1
        said = [line[3:].strip() for line in raw[first:end] if line.startswith(("///", "//!"))]
        return "\n".join(said) or None

    return above


def _brace_file(
    filepath: str, content: str, language: Language, methods: bool, variables: bool
) -> Iterator[dict]:
    """Entities of one file in the order of their lines."""
    lines = content.split("\n")
    found, balanced = pieces(language.blank(content))
    module = _MODULE_ENDING.sub("", re.split(r"[\\/]", filepath)[-1])
    entities: list[dict] = []
    if balanced:
        top_ends, inside_ends = ends(found, re.compile(language.goes_on))
        docs = _docs(lines, language)
        continued = re.compile(language.continued)
        owner: tuple[str, str, bool] = ("", "", False)
        until = -1  # the last piece of the latest impl header
        members = {o: [d for name, d in language.members if name == o] for o, _ in language.members}
        for i, piece in enumerate(found):
            code = piece.code
            if not code or i <= until:
                continue
            if piece.depth == 0:
                header = code
                if re.match(r"\s*(?:unsafe\s+)?impl\b", code):
                    header, until = _whole_header(found, i)
                entry = _declared(header, language.top)
                if not continued.match(code.strip()):
                    owner = entry or ("", "", False)
                parent, end = None, top_ends[i]
            elif piece.depth == 1 and methods and owner[0] in members:
                entry = _declared(code, members[owner[0]])
                parent, end = owner[1], inside_ends[i]
            else:
                continue
            if entry is None:
                continue
            kind, name, marked = entry
            if parent is not None:
                if kind in ("method", "enum_variant"):
                    marked = owner[2]
                parent = None if kind == "enum_variant" else _impl_names(parent)[0] if owner[0] == "impl" else parent
            elif kind == "impl":
                name = _impl_names(name)[1] or "impl"
            end = max(end, piece.line)
            text = "\n".join(lines[piece.line - 1 : end])
            text = text.strip() if language.block_docs else text
            if kind == "variable":
                arrow = bool(_ARROW.match(text))
                if not (arrow and marked or variables and (arrow or _TYPED.match(text))):
                    continue
                kind = "function" if arrow else kind
            entities.append(
                {
                    "entity_type": kind,
                    "name": name,
                    "code": text,
                    "parent_context": parent,
                    "start_line": piece.line,
                    "end_line": end,
                    "is_exported": marked,
                    "doc": docs(piece.line) if piece.first else None,
                }
            )
    if not entities and content.strip() and (language.module_when_empty or not balanced):
        entities.append(
            {
                "entity_type": language.module_type,
                "name": module,
                "qualified_name": module,
                "code": content,
                "start_line": 1,
                "end_line": len(lines) - content.endswith("\n"),
                "is_exported": False,
            }
        )
    for number, entity in enumerate(entities):
        names = [module] if language.prefix_module else []
        names += [n for n in (entity.get("parent_context"), entity["name"]) if n]
        yield {
            "filepath": filepath,
            "entity_no": number,
            "qualified_name": language.separator.join(names),
            "is_balanced": balanced,
            **entity,
        }


_PARAMS = "\\(((?:[^()]++|\\((?:[^()]++|\\([^()]*+\\))*+\\))*+)\\)"


# What stands between parameters and return type.
_RETURN_MARKS = {"typescript": "\\s*:\\s*", "rust": "\\s*->\\s*"}


def _with_signature(rows: DataFrame) -> DataFrame:
    """Parameters and return type of functions and methods of brace languages, read from their code."""
    language = document_type(F.col("filepath"))
    callable_ = F.col("entity_type").isin("function", "method")
    inner = F.regexp_replace(
        F.regexp_replace(F.regexp_extract("code", _PARAMS, 1), "\\s*\\n\\s*", " "), "\\A\\s+|,?\\s*\\z", ""
    )
    parameters, returned = F.col("parameters"), F.col("return_type")
    for name, mark in _RETURN_MARKS.items():
        pattern = "\\A[^(]*" + _PARAMS + mark + "([^{;=]+?)\\s*(?:\\{|=>|;|where\\b|\\z)"
        found = F.nullif(F.regexp_extract("code", pattern, 2), F.lit(""))
        own = callable_ & (language == name)
        parameters = F.when(own, F.concat(F.lit("("), inner, F.lit(")"))).otherwise(parameters)
        returned = F.when(own, found).otherwise(returned)
    return rows.withColumns({"parameters": parameters, "return_type": returned})


def _python_file(filepath: str, content: str) -> Iterator[dict]:
    """Entities of one Python file; a file that does not parse is one module entity."""
    module = filepath.replace("\\", "/").rsplit("/", 1)[-1]
    module = module[:-3] if module.lower().endswith(".py") else module
    lines = content.split("\n")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        tree = None
    found: list[dict] = []

    def add(node, kind: str, parent: str | None) -> None:
        start = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        names = [module, *([parent] if parent else []), node.name]
        is_function = kind != "class"
        arguments = f"({ast.unparse(node.args)})" if is_function else None
        returns = ast.unparse(node.returns) if is_function and node.returns else None
        found.append(
            {
                "entity_type": kind,
                "name": node.name,
                "qualified_name": ".".join(names),
                "code": "\n".join(lines[start - 1 : node.end_lineno]),
                "parent_context": parent,
                "start_line": start,
                "end_line": node.end_lineno,
                "doc": ast.get_docstring(node),
                "parameters": arguments,
                "return_type": returns,
            }
        )

    def visit(body, parent: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                add(node, "method" if parent else "function", parent)
            elif isinstance(node, ast.ClassDef):
                add(node, "class", None)
                visit(node.body, node.name)
            else:
                for field in ("body", "orelse", "finalbody"):
                    visit(getattr(node, field, []) or [], parent)

    if tree is not None:
        visit(tree.body, None)
    if not found and content.strip():
        found.append(
            {
                "entity_type": "module",
                "name": module,
                "qualified_name": module,
                "code": content,
                "start_line": 1,
                "end_line": len(lines) - content.endswith("\n"),
                "doc": ast.get_docstring(tree) if tree is not None else None,
            }
        )
    for number, entity in enumerate(found):
        yield {
            "filepath": filepath,
            "entity_no": number,
            "is_exported": False,
            "is_balanced": tree is not None,
            **entity,
        }


def by_file(files: DataFrame, read: Callable[[str, str], Iterator[dict]]) -> DataFrame:
    """Entities that ``read`` finds in each (filepath, content), file by file inside tasks."""
    columns = ENTITY.fieldNames()

    kinds = [to_arrow_type(field.dataType) for field in ENTITY.fields]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(n) for n in (0, 1)]
            rows: list[dict] = []
            size = 0
            for number in range(batch.num_rows):
                for entity in read(texts[0][number].as_py(), texts[1][number].as_py() or ""):
                    rows.append(entity)
                    size += len(entity["code"] or "")
                    if len(rows) >= MOST_ROWS or size >= MOST_CHARS:
                        yield handed(rows)
                        rows, size = [], 0
            if rows:
                yield handed(rows)

    def handed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(columns, kinds)], names=columns
        )

    return files.select("filepath", "content").mapInArrow(extract, ENTITY)


# Further languages: a brace language is an entry of LANGUAGES, others give a job of this shape. Both need
# their file endings in ``functions.paths``.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def _reader(methods: bool, variables: bool) -> Callable[[str, str], Iterator[dict]]:
    languages = {ending: LANGUAGES[name] for name in LANGUAGES for ending in CODE_ENDINGS.get(name, ())}

    def read(filepath: str, content: str) -> Iterator[dict]:
        language = languages.get(filepath.rsplit(".", 1)[-1].lower())
        if language is None:
            return _python_file(filepath, content)
        return _brace_file(filepath, content, language, methods, variables)

    return read


def extract_entities(
    files: DataFrame,
    methods: bool = True,
    variables: bool = False,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Entities of code files (filepath, content), with the checksum of their code.

    Files of all languages are read in one pass; a language with a job of its own is a pass of its own.
    ``languages`` limits the work to some of the known ones.
    """
    names = (*LANGUAGES, "python", *EXTRACTORS) if languages is None else tuple(languages)
    for name in names:
        if name not in CODE_ENDINGS:
            raise ValueError(f"no file endings are known for {name}")
        if name not in (*LANGUAGES, "python", *EXTRACTORS):
            raise ValueError(f"no reader is known for {name}")
    typed = files.select("filepath", "content", document_type(F.col("filepath")).alias("_type"))
    together = [name for name in names if name not in EXTRACTORS]
    parts = []
    if together:
        own = typed.filter(F.col("_type").isin(together))
        parts.append(_with_signature(by_file(own, _reader(methods, variables))))
    parts += [EXTRACTORS[n](typed.filter(F.col("_type") == n).drop("_type")) for n in names if n in EXTRACTORS]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("checksum", content_checksum(F.col("code")))


def file_outline(files: DataFrame) -> DataFrame:
    """Imports and module documentation per file."""
    kind = document_type(F.col("filepath"))
    all_of = lambda pattern: F.transform(
        F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), trim_space
    )
    imports = (
        F.when(kind == "typescript", all_of(TYPESCRIPT.imports))
        .when(kind == "rust", all_of(RUST.imports))
        .when(kind == "python", all_of("(?m)^(?:from\\s+[\\w.]+\\s+)?import\\s+(?:\\([^)]*\\)|[^\\n]*)"))
    )
    rust_doc = F.array_join(
        F.transform(
            F.split(F.regexp_extract("content", "\\A((?:\\s*//[!/][^\\n]*\\n?)+)", 1), "\n"),
            lambda x: trim_space(F.regexp_replace(trim_space(x), "\\A//[!/]", "")),
        ),
        "\n",
    )
    doc = (
        F.when(kind == "typescript", F.regexp_extract("content", "/\\*[\\s\\S]*?\\*/", 0))
        .when(kind == "rust", trim_space(rust_doc))
        .when(kind == "python", trim_space(F.regexp_extract("content", '\\A\\s*(?:#[^\\n]*\\n\\s*)*"""([\\s\\S]*?)"""', 1)))
    )
    return files.select("filepath", imports.alias("imports"), F.nullif(doc, F.lit("")).alias("module_doc"))
