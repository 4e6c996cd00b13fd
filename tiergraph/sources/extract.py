"""Code units from source files: Python by its own parser, Rust, Go, JavaScript and TypeScript by patterns.

Files are read with Spark's binary reader, so a repository may lie in any store that Spark reads;
each file is parsed by itself, in Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.schema import CODE_UNITS
from tiergraph.sources import directory as X

# Languages by file extension.
LANGUAGES = {"rs": "Rust", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go"}

# Words that branch, loop and handle errors, by language. Of a match arm the guard is no branch, of do ... while the end is no loop.
BRANCH = {"Rust": r"\bif\b(?![^{};]*=>)|\bmatch\b", "Go": r"\bif\b", "js": r"\b(?:if|switch)\b"}
LOOP = {"Rust": r"\bfor\b(?!\s*<)|\b(?:while|loop)\b", "Go": r"\bfor\b", "js": r"\b(?:for|while)\b"}
HANDLE = {"Rust": r"\bmatch\b", "Go": r"\bif\b", "js": r"\b(?:try|catch)\b"}
KEYWORDS = {
    "Rust": {"if", "for", "while", "match", "return", "fn", "loop", "else", "in", "move", "as", "let", "await", "unsafe", "break", "where", "impl", "dyn", "mut", "ref"},
    "Go": {"if", "for", "switch", "return", "func", "select", "else", "import", "case", "defer", "go", "range", "chan", "map", "interface", "struct"},
    "js": {"if", "for", "while", "switch", "return", "catch", "function", "else", "typeof", "new", "await", "super", "in", "import", "let", "case", "void", "delete", "throw", "yield", "async", "of", "do", "with"},
}
# Calls that wrap a component, and calls whose callback makes none.
WRAPPERS = ["forwardRef", "memo", "observer", "connect"]
NO_COMPONENT = ["setTimeout", "setInterval", "queueMicrotask", "map", "filter", "reduce", "forEach", "find", "some", "every"]

RUST_FN = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", re.M)
GO_FN = re.compile(r"^func\s+(\w+)\s*[\[(]", re.M)
JS_FN = re.compile(r"(?:^|(?<=[;{}\s(]))(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(", re.M)
JS_ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;\n]+)?=\s*(?=(?:async\s*)?(?:<[^>]*>\s*)?(?:\((?:[^()]|\([^()]*\))*\)|\w+)\s*(?::[^=\n]+)?=>)")
JS_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*[*#]?(\w+)\s*(?:<[^>]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^{;=\n]+)?\{", re.M)
JS_WRAPPED = re.compile(r"^(?:export\s+)?(?:const|let)\s+(\w+)\s*(?::[^=;\n]+)?=\s*([\w.]+)(?=\s*(?:<[^>]*>\s*)?[(`])", re.M)
JS_DEFAULT = re.compile(r"^export\s+default\s+([\w.]+)(?=\s*[(`])", re.M)
RUST_MACRO = re.compile(r"\b\w+!\s*([(\[{])")
CALL = re.compile(r"(?<![\w:])(\w+)\s*(?:\?\.)?\(")
RUST_USE = re.compile(r"(?:^|(?<=[;}\s]))(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);")
JS_IMPORT = re.compile(r"""(?:^|(?<=[;}\s]))import\s+(?:[^'"();=]*?\sfrom\s*|[^'"();=]*?\}\s*from\s*)?['"]([^'"]+)['"]""")
GO_IMPORT = re.compile(r"""^[ \t]*import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?["`]([^"`]+)["`])""", re.M)
CFG_TEST = re.compile(r"#\[cfg\([^\]]*\btest\b[^\]]*\)\]\s*(?:pub\s+)?mod\s+\w+\s*\{")


def family(language: str) -> str:
    return "js" if language in ("JavaScript", "TypeScript") else language


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """SRC1. path (relative to root), language, content, content_hash of the source files below root.

    Hidden files and what .ignore files (and, in a git checkout, .gitignore files) name are left out, and
    the paths of exclude. Files whose name or folder begins with an underscore are passed over by Spark's
    readers. What an ignore file below the files' own folders says doesn't matter, so files are looked at
    down to their own depth.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(root)
    clean = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = "/" + re.sub(r"^[a-z]+:/+", "/", root).strip("/") + "/"
    rel = F.when(clean.startswith(base), F.substring(clean, F.lit(len(base) + 1), F.char_length(clean))).otherwise(clean)
    rows = files.select(rel.alias("path"), "content")
    for d in exclude or []:
        d = d.strip("/")
        rows = rows.where(~(F.col("path").startswith(d + "/") | F.col("path").contains(f"/{d}/") | (F.col("path") == d)))
    depth = rows.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    rows = rows.where(~X.ignored(F.col("path"), X.ignore_rules(X.ignore_files(spark, root, depth - 1))))
    lookup = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return rows.select("path", lookup[F.regexp_extract("path", r"\.(\w+)$", 1)].alias("language"), "content", F.sha2("content", 256).alias("content_hash"))


def block_end(code: str, start: int) -> int:
    """Place after the brace that closes the first one from start; strings and comments may hold braces."""
    depth = 0
    for m in re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`|[{};]""", re.S).finditer(code, start):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == ";" and depth == 0:
            return m.end()
    return len(code)


TEXT = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n]|\\u\{[^}]*\})'""", re.S)
JS_TEXT = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def blank(code: str, lang: str, strings: bool = True) -> str:
    """code with comments (and what strings hold) as blanks, places kept."""

    def gap(m: re.Match) -> str:
        text = m.group()
        if text[0] not in "\"'`":
            return re.sub(r"[^\n]", " ", text)
        return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1] if strings else text

    return (JS_TEXT if lang == "js" else TEXT).sub(gap, code)


def without_macros(text: str) -> str:
    """Rust without the tokens inside macro calls, which are no expressions of the language."""
    closing = {"(": ")", "[": "]", "{": "}"}
    out, at = [], 0
    for m in RUST_MACRO.finditer(text):
        if m.start() < at:
            continue
        k, depth = m.end(), 1
        while k < len(text) and depth:
            depth += (text[k] == m[1]) - (text[k] == closing[m[1]])
            k += 1
        out.append(text[at : m.start()])
        at = k
    return "".join(out) + text[at:]


def body_text(body: str, lang: str) -> str:
    text = blank(body, lang)
    return without_macros(text) if lang == "Rust" else text


def metrics_of(body: str, lang: str) -> tuple[int, bool, bool, bool]:
    """SRC9. complexity = 1 + branches + loops, and the three flags."""
    text = body_text(body, lang)
    branches, loops = (len(re.findall(p[lang], text)) for p in (BRANCH, LOOP))
    if lang == "js":
        loops -= len(re.findall(r"\bdo\s*\{", text))
    return 1 + branches + loops, branches > 0, loops > 0, bool(re.search(HANDLE[lang], text))


def calls_of(body: str, lang: str) -> list[str]:
    """SRC8. The name of every call in a body, repeats included: a plain name, or the last member of a chain.

    Rust's paths (a::b()) and macros, and JavaScript's new, are no calls of this kind.
    """
    text = body_text(body, lang)
    if lang == "Rust":
        text = re.sub(r"::\s*<[^<>]*>\s*\(", " (", text)
    found = []
    for m in CALL.finditer(text):
        before = text[: m.start()].rstrip()
        if m[1] in KEYWORDS[lang] or m[1][0].isdigit() or re.search(r"\b(?:fn|func|function|new)$", before[-9:]):
            continue
        found.append(m[1])
    return found


def top_level(code: str, lang: str) -> str:
    """code where what stands inside braces is blank, comments too; braces of a use or import list stay."""
    text = blank(code, lang, strings=False)
    bare = blank(code, lang)
    out, depth, listed = [], 0, 0
    for k, c in enumerate(bare):
        if c == "{" and not depth and re.search(r"(?:\buse\s[^;{}]*|\bimport\s[^;{}'\"]*|\bimport\s*type\s[^;{}'\"]*)$", bare[max(0, k - 300) : k]):
            listed += 1
        elif c == "{" and listed:
            listed += 1
        elif c == "}" and listed:
            listed -= 1
        elif c == "{":
            depth += 1
            out.append("{")
            continue
        elif c == "}":
            depth = max(0, depth - 1)
            out.append("}")
            continue
        out.append(text[k] if not depth or c == "\n" else " ")
    return "".join(out)


def imports_of(code: str, language: str) -> list[str]:
    """SRC7. What a file's top-level import statements name, each once.

    Rust: the whole argument of use; JavaScript and TypeScript: the module of an import statement;
    Go: the path; Python: the statement itself (statements of __future__ are none).
    """
    if language == "Python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError):
            return []
        named = [n for n in tree.body if isinstance(n, ast.Import) or (isinstance(n, ast.ImportFrom) and n.module != "__future__")]
        return list(dict.fromkeys((ast.get_source_segment(code, n) or "").strip() for n in named))
    if language == "Go":
        found = []
        for block, one in GO_IMPORT.findall(blank(code, "Go", strings=False)):
            found += [one] if one else re.findall(r"[\"`]([^\"`]+)[\"`]", block)
        return list(dict.fromkeys(found))
    top = top_level(code, family(language))
    found = (RUST_USE if language == "Rust" else JS_IMPORT).findall(top)
    return list(dict.fromkeys(x.strip() for x in found if x.strip()))


def python_units(path: str, code: str, imports: list[str]) -> list[dict]:
    """SRC3, SRC4. Every function, nested ones and methods too."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    lines, out = code.split("\n"), []
    for n in ast.walk(tree):
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        inner = list(ast.walk(n))
        # an elif is a clause of its if, not a branch of its own
        clauses = {id(x.orelse[0]) for x in inner if isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and lines[x.orelse[0].lineno - 1].lstrip().startswith("elif")}
        branches = sum(isinstance(x, ast.If) and id(x) not in clauses for x in inner)
        loops = sum(isinstance(x, (ast.For, ast.AsyncFor, ast.While)) for x in inner)
        names = [x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in inner if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))]
        text = "\n".join(lines[n.lineno - 1 : n.end_lineno]).lstrip()
        out.append(_unit(n.name, n.lineno, text, names, imports, (1 + branches + loops, branches > 0, loops > 0, any(isinstance(x, ast.Try) for x in inner))))
    return sorted(out, key=lambda u: (u["line"], u["name"]))


def _unit(name: str, line: int, code: str, calls: list[str], imports: list[str], metrics: tuple[int, bool, bool, bool]) -> dict:
    complexity, branches, loops, errors = metrics
    return dict(
        name=name, unit_type="function", line=line, end_line=line + code.count("\n"), signature=code.split("{")[0].strip().split("\n")[0], code=code, docstring=None, parent_class=None,
        calls=calls, imports=imports, complexity=complexity, has_branches=branches, has_loops=loops, has_error_handling=errors, qualified_name=name,
    )


def _statement_end(code: str, start: int) -> int:
    """Place after the statement from start: its semicolon, or the line's end once no bracket is open."""
    text = blank(code[start:], "js")
    depth = 0
    for k, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return start + k
        elif depth == 0 and (c == ";" or (c == "\n" and k and not re.match(r"\s*[.?:=(\[{`+&|]|\s*=>", text[k:]) and not re.search(r"(?:=>|[=({\[,&|+?:])\s*$", text[:k]))):
            return start + k + (c == ";")
    return len(code)


def _after_brackets(text: str, start: int) -> int:
    """Place after the bracket that closes the one at start."""
    depth = 0
    for k in range(start, len(text)):
        depth += (text[k] in "([{") - (text[k] in ")]}")
        if depth == 0:
            return k + 1
    return len(text)


def is_wrapper(callee: str) -> bool:
    return callee in WRAPPERS or bool(re.match(r"with[A-Z]", callee))


def wraps_component(callee: str, rest: str) -> bool:
    """SRC6. Whether a call (callee, and what follows it) makes a component: a styled template, a wrapper, or React's wrapper of an inline function."""
    if callee == "styled" or callee.startswith("styled."):
        return True
    if "." not in callee:
        return is_wrapper(callee)
    inline = re.match(r"\s*(?:<[^>]*>\s*)?\(\s*(?:async\s*)?(?:function\b|\w+\s*=>|\((?:[^()]|\([^()]*\))*\)\s*(?::[^=\n]+)?=>)", rest)
    owner, member = callee.rsplit(".", 1)
    return bool(inline) and owner == "React" and is_wrapper(member) and member not in NO_COMPONENT


def js_units(path: str, code: str) -> list[tuple[str, int, int]]:
    """SRC5, SRC6. (name, start, end) of function declarations, methods, arrows bound to a name, and wrapped components."""
    bare = blank(code, "js")
    out, wrapped = [], []
    for m in JS_WRAPPED.finditer(bare):
        if bare.count("{", 0, m.start()) == bare.count("}", 0, m.start()) and wraps_component(m[2], code[m.end() :]):
            start = re.search(r"(?:const|let)\b", code[m.start() :]).start() + m.start()
            wrapped.append((m[1], start, _statement_end(code, m.end())))
    for m in JS_DEFAULT.finditer(bare):
        if wraps_component(m[1], code[m.end() :]):
            base = path.rsplit("/", 1)[-1].split(".")[0]
            folder = path.rsplit("/", 2)[-2] if "/" in path else ""
            out.append((folder or base if base in ("index", "styled") else base, m.start(), _statement_end(code, m.end())))
    inside = lambda at: any(a <= at < b for _, a, b in wrapped)
    for m in JS_FN.finditer(bare):
        start = re.search(r"(?:async\s+)?function", code[m.start() :]).start() + m.start()
        if not inside(start):
            out.append((m[1], start, block_end(code, _after_brackets(bare, m.end() - 1))))
    for m in JS_ARROW.finditer(bare):
        if not inside(m.start()):
            arrow = bare.index("=>", m.end()) + 2
            opens = re.match(r"\s*\{", bare[arrow:])
            out.append((m[1], m.end(), block_end(code, arrow) if opens else _statement_end(code, arrow)))
    for m in JS_METHOD.finditer(bare):
        if m[1] not in KEYWORDS["js"] and not inside(m.start()):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((m[1], start, block_end(code, m.end() - 1)))
    return out + wrapped


def pattern_units(path: str, code: str, language: str, imports: list[str]) -> list[dict]:
    """SRC3 to SRC6. Functions by pattern, each up to its closing brace."""
    lang = family(language)
    if lang == "js":
        spans = js_units(path, code)
    else:
        bare = blank(code, lang)
        spans = []
        for m in (RUST_FN if lang == "Rust" else GO_FN).finditer(bare):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            spans.append((m[1], start, block_end(code, m.end())))
    out = {}
    for name, start, end in spans:
        body = code[start:end]
        head = re.search(rf"\b{re.escape(name)}\b", body)
        calls = calls_of(body[head.end() if head else 0 :], lang) if lang != "js" else [c for k, c in enumerate(calls_of(body, lang)) if not (k == 0 and c == name and re.match(rf"(?:\w+\s+)*[*#]?{re.escape(name)}\s*(?:<[^>]*>)?\(", body))]
        out[name, start] = _unit(name, code.count("\n", 0, start) + 1, body, calls, imports, metrics_of(body, lang))
    return sorted(out.values(), key=lambda u: (u["line"], u["name"]))


def units_of(path: str, language: str, content: bytes) -> list[dict]:
    """SRC2, SRC10. Units of a file; a file with imports alone gives one nameless marker."""
    code = content.decode("utf-8", "replace")
    imports = imports_of(code, language)
    found = python_units(path, code, imports) if language == "Python" else pattern_units(path, code, language, imports)
    if not found and imports:
        marker = _unit("", 1, "", [], imports, (0, False, False, False))
        found = [marker | {"unit_type": "file_imports_marker", "signature": None, "code": None, "qualified_name": path.replace("/", "::") + "::file_imports_marker"}]
    return [u | {"file": path, "language": language} for u in found]


def cfg_test_functions(code: str) -> list[str]:
    """SRC13. Functions inside modules that are compiled for tests only."""
    out = []
    for m in CFG_TEST.finditer(code):
        out += RUST_FN.findall(code[m.start() : block_end(code, m.end() - 1)])
    return list(dict.fromkeys(out))


# A module declaration, with or without a path attribute.
MOD = re.compile(r"""(?:#\[path\s*=\s*"([^"]+)"\]\s*)?^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;""", re.M)


def mod_declarations(code: str) -> list[tuple[str, str | None]]:
    """SRC14. (name, path attribute) of the modules a Rust file declares."""
    return [(name, path or None) for path, name in MOD.findall(re.sub(r"//[^\n]*", "", code))]


def module_map(files: DataFrame, roots: list[str] | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """SRC14. path, logical: the crate path of each Rust file reached from the crate roots by mod declarations.

    files has path and content; a level of declarations is one join, and a file is reached once, so the
    walk ends however deep modules are nested. settle may store a level.
    """
    schema = "path string, name string, attr string"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(p, n, a) for p, c in zip(pdf["path"], pdf["content"]) for n, a in mod_declarations(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "name", "attr"])

    rust = files.where("language = 'Rust'").select("path", "content")
    decl = rust.mapInPandas(run, schema)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = F.when(F.regexp_like("path", F.lit(r"(^|/)(mod|lib|main)\.rs$")), folder).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    join = lambda d, x: F.when(d == "", x).otherwise(F.concat(d, F.lit("/"), x))
    target = F.when(F.col("attr").isNotNull(), F.array(join(folder, F.col("attr")))).otherwise(F.array(join(own, F.concat("name", F.lit(".rs"))), join(own, F.concat("name", F.lit("/mod.rs")))))
    edges = decl.select("path", "name", F.explode(target).alias("child")).join(rust.select(F.col("path").alias("child")), "child", "left_semi")
    tops = rust.where(F.col("path").isin(roots)) if roots else rust.where(F.regexp_like("path", F.lit(r"(^|/)src/(lib|main)\.rs$")))
    level = tops.select("path", F.lit("crate").alias("logical"))
    out = level
    edges = settle(edges)
    while True:
        level = level.join(edges, "path").select(F.col("child").alias("path"), F.concat("logical", F.lit("::"), "name").alias("logical")).join(out.select("path"), "path", "left_anti")
        level = settle(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy("path").agg(F.min("logical").alias("logical"))


def code_units(files: DataFrame) -> DataFrame:
    """SRC2 to SRC10. One row a unit of files (path, language, content), by schema.CODE_UNITS."""
    names = [c.strip().split(" ")[0] for c in CODE_UNITS.split(",")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [u for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"]) for u in units_of(p, lang, bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, CODE_UNITS)


class CodeExtractor:
    """SRC11. The interface of an extractor: files in, code units out."""

    def index(self, spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
        return code_units(scan(spark, root, exclude))
