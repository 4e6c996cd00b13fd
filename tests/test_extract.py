"""Extraction, manifests, detection, documents and settings."""

import pytest
from sample import FILES, WEB, write

from tiergraph.errors import ConfigError, InvalidInput, NotFound
from tiergraph.sources import config, directory, documents, extract, manifests


def units(spark, root):
    rows = extract.code_units(extract.scan(spark, root)).collect()
    return {(u.file, u.name): u for u in rows}


def test_rust_units(spark, tmp_path):
    got = units(spark, write(tmp_path, FILES))
    start = got["core/src/lib.rs", "start"]
    assert (start.line, start.end_line, start.complexity) == (5, 9, 3)
    assert start.has_branches and start.has_loops and start.calls == ["open"]  # a path is no plain call
    assert ("core/src/store.rs", "Store") not in got and {u.unit_type for u in got.values()} == {"function"}
    assert got["core/src/store.rs", "open"].has_error_handling
    step = got["core/src/walk.rs", "step"]
    assert (step.line, step.end_line, step.complexity) == (1, 5, 2)
    assert start.imports == ["crate::store::open"]


def test_other_languages(spark, tmp_path):
    got = units(spark, write(tmp_path, WEB))
    assert not any("node_modules" in f for f, _ in got)
    assert {n for _, n in got} & {"made", "gen", "keep", "hidden"} == {"keep"}
    run = got["src/app/index.ts", "run"]
    assert run.imports == ["../lib/helper", "@/ui/button", "react"] and run.complexity == 2 and run.language == "TypeScript"
    assert got["src/lib/helper.ts", "other"].has_error_handling and got["src/lib/helper.ts", "helper"].has_loops
    assert ("src/ui/button.tsx", "Button") in got and ("src/ui/button.tsx", "Panel") not in got
    marker = got["src/only/imports.js", ""]
    assert (marker.unit_type, marker.line, marker.end_line, marker.complexity, marker.qualified_name) == ("file_imports_marker", 1, 1, 0, "src::only::imports.js::file_imports_marker")
    go = got["py/pkg/tool.py", "go"]
    assert (go.unit_type, go.parent_class, go.qualified_name, go.complexity) == ("function", None, "go", 2)
    assert go.docstring is None and go.imports == ["from . import other", "import os"] and sorted(go.calls) == ["help_me", "range"]
    main = got["go/main.go", "main"]
    assert main.imports == ["fmt", "example.org/go/helper"] and main.complexity == 3 and main.calls == ["Println", "Help"] and main.has_error_handling


@pytest.mark.parametrize(
    ("lang", "body", "want"),
    [
        # complexity, branches, loops, error handling
        ("Rust", "fn f() { match x { A if y > 1 => 1, _ => { if z { 2 } else if q { 3 } else { 4 } } } }", (4, True, False, True)),
        ("Rust", "fn f() { while let Some(x) = i.next() { loop { break; } } a?; println!(\"{}\", if b { 1 } else { 2 }); }", (3, False, True, False)),
        ("Rust", "fn f<F>(g: F) where F: for<'a> Fn(&'a u8) { for x in y { } }", (2, False, True, False)),
        ("js", "function f() { do { a(); } while (b); return c ? 1 : 2; }", (1, False, False, False)),
        ("js", "function f() { switch (a) { case 1: break; } for (const k in o) { } try { } catch (e) { } // if while", (3, True, True, True)),
        ("Go", "func f() { switch a { case 1: }; select { }; if err != nil { return err } }", (2, True, False, True)),
    ],
)
def test_metrics_count_statements_of_their_kinds(lang, body, want):
    assert extract.metrics_of(body, lang) == want


def test_python_metrics():
    code = "def f(a):\n    if a:\n        pass\n    elif a > 1:\n        pass\n    else:\n        if a:\n            pass\n    x = 1 if a else 2\n    return [y for y in x]\n"
    (f,) = extract.units_of("a.py", "Python", code.encode())
    assert (f["complexity"], f["has_branches"], f["has_loops"], f["has_error_handling"]) == (3, True, False, False)


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("Rust", "use a::{b, c};\npub use x::y as z;\nuse super::*;\nmod m {\n    use inner::q;\n}\nfn f() { use local::x; }\n// use no::no;\n", ["a::{b, c}", "x::y as z", "super::*"]),
        ("JavaScript", "import a from 'a';\nimport { b,\n c } from \"./b\";\nimport './c.css';\nexport { d } from './d';\nconst e = require('e');\nfunction f() { import('g'); }\n", ["a", "./b", "./c.css"]),
        ("TypeScript", "import type { A } from './a';\nimport b = require('b');\nimport * as c from 'c'\n", ["./a", "c"]),
        ("Python", "from __future__ import annotations\nimport os, sys\nfrom . import (a,\n  b)\ndef f():\n    import json\n", ["import os, sys", "from . import (a,\n  b)"]),
        ("Go", "package a\nimport \"fmt\"\nimport (\n\tx \"a/b\"\n\t_ \"c\" // \"d\"\n)\n", ["fmt", "a/b", "c"]),
    ],
)
def test_imports_are_top_level_statements(language, code, want):
    assert extract.imports_of(code, language) == want


@pytest.mark.parametrize(
    ("path", "code", "names"),
    [
        ("a.js", "const X = styled.div`a`;\nexport const Y = withStore(Z);\nconst p = arr.map((x) => x);\nconst t = setTimeout(() => 1, 2);\nconst { a, b } = memo(c);\n", ["X", "Y"]),
        ("a.js", "const M = React.memo(() => { return 1; });\nconst N = foo.memo(() => 1);\nconst S = styled(Base)`x`;\n", ["M", "S"]),
        ("ui/Button/index.js", "export default observer(function () { return 1; });\n", ["Button"]),
        ("ui/card.jsx", "export default forwardRef((p, r) => 1);\n", ["card"]),
        ("a.js", "class A { go(x) { return x; } async run() { } }\nexport default function main() { }\nexport const f = async (a, b) => a + b;\n[1].map((x) => x);\n", ["go", "run", "main", "f"]),
    ],
)
def test_javascript_units(path, code, names):
    assert [u["name"] for u in extract.units_of(path, "JavaScript", code.encode())] == names


def test_calls():
    assert extract.calls_of("{ a(b(1)); self.c.d(); E::f(); g!(h()); i::<u8>(); }", "Rust") == ["a", "b", "d", "i"]
    assert extract.calls_of("{ a.b.c(); new D(); if (e) { f?.(g()); } }", "js") == ["c", "f", "g"]


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [
        ("build/", "build/a.js", True), ("build/", "src/build/a.js", True), ("build/", "src/build", False), ("/build", "src/build/a.js", False), ("/build", "build/a.js", True), ("a/b", "x/a/b/c.js", False),
        ("a/b", "a/b/c.js", True), ("*.min.js", "x/y.min.js", True), ("*.min.js", "x/y.js", False), ("**/gen", "x/gen/a.js", True), ("gen/**", "gen/a/b.js", True), ("gen/**", "gen", False), ("a/**/z.js", "a/z.js", True),
        ("a/**/z.js", "a/b/c/z.js", True), ("*.js\n!k.js", "a/k.js", False), ("d/\n!d/k.js", "d/k.js", True), ("f?o.js", "foo.js", True), ("[ab].js", "b.js", True), ("[!ab].js", "b.js", False), ("# c\n\n", "c", False), ("\\#a.js", "#a.js", True), ("", ".hid/a.js", True),
    ],
)
def test_ignore_rules(spark, text, path, want):
    from pyspark.sql import functions as F

    rules = directory.ignore_rules({".ignore": text})
    assert spark.range(1).select(directory.ignored(F.lit(path), rules)).first()[0] == want


def test_gitignore_counts_in_a_checkout_only(spark, tmp_path):
    root = write(tmp_path, {".gitignore": "b.py\n", "a.py": "x = 1\n", "b.py": "x = 1\n"})
    assert {r.path for r in extract.scan(spark, root).collect()} == {"a.py", "b.py"}
    (tmp_path / ".git").mkdir()
    assert {r.path for r in extract.scan(spark, root).collect()} == {"a.py"}


def test_directories_and_files(spark, tmp_path):
    root = write(tmp_path, {"src/a.rs": "fn a() {}", "b.md": "x" * 40_000, "src/deep/c.rs": ""})
    got = directory.list_directory(spark, root, "./", {"b.md": "B", "./src": "S"})
    assert [(e["path"], e["entity_id"], e["indexed"], e["is_dir"]) for e in got] == [("src/", "S", True, True), ("b.md", "B", True, False)]
    assert [e["path"] for e in directory.list_directory(spark, root, "src/", {})] == ["deep/", "a.rs"]
    text = directory.read_file(spark, root, "b.md")
    assert len(text) == 32_768 and text.endswith("x...") and directory.read_file(spark, root, "src/a.rs") == "fn a() {}"
    (tmp_path / "out").symlink_to("/etc")
    for bad in ("../x", "/etc", "src/../../x", "out", "src/a.rs"):
        with pytest.raises(InvalidInput):
            directory.list_directory(spark, root, bad, {})
    with pytest.raises(NotFound):
        directory.list_directory(spark, root, "none", {})
    with pytest.raises(NotFound):
        directory.read_file(spark, root, "none")
    with pytest.raises(InvalidInput):
        directory.read_file(spark, root, "out/hostname")


def test_broken_files_give_nothing(spark, tmp_path):
    got = units(spark, write(tmp_path, {"a.py": "def f(:\n", "b.rs": "fn x() {", "c.js": "\xff\x00", "d.go": ""}))
    assert set(got) == {("b.rs", "x")}


def test_test_only_functions_and_modules(spark, tmp_path):
    assert extract.cfg_test_functions(FILES["core/src/store.rs"]) == ["checks_open"]
    assert extract.mod_declarations('#[path = "x/y.rs"]\nmod a;\npub mod b;\n// mod c;\nmod d { }') == [("a", "x/y.rs"), ("b", None)]
    got = {r.path: r.logical for r in extract.module_map(extract.scan(spark, write(tmp_path, FILES))).collect()}
    assert got["core/src/store.rs"] == "crate::store" and got["core/src/walk.rs"] == "crate::walk" and got["core/src/lib.rs"] == "crate"


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ({"Gemfile": "gem 'rails'\n  gem \"pg\", '1'\n"}, ("ruby", ["rails", "pg"])),
        ({"pyproject.toml": "[project]\ndependencies = ['Django>=4', 'x[y]; a']\n"}, ("python", ["Django", "x"])),
        ({"pyproject.toml": "[build-system]\n", "requirements.txt": "flask==1\n# no\n-r other\nx!=2\n"}, ("python", ["flask", "x!"])),
        ({"package.json": '{"dependencies": {"next": "1"}, "devDependencies": {"b": "1"}}'}, ("javascript", ["b", "next"])),
        ({"package.json": "not json"}, ("javascript", [])),
        ({"composer.json": '{"require": {"laravel/framework": "1"}, "require-dev": {"x/y": "1"}}'}, ("php", ["laravel/framework"])),
        ({"go.mod": "module x\nrequire c/d v1\nrequire (\n\tgithub.com/a/b v1.2\n\t// no\n)\n"}, ("go", ["c/d", "github.com/a/b"])),
        ({"pom.xml": "<artifactId>me</artifactId><dependency><artifactId>spring-boot-starter</artifactId></dependency>"}, ("java", ["spring-boot-starter"])),
        ({"build.gradle": "implementation 'org.a:b:1'\nimplementation('c')\ntestImplementation 'd:e'\n"}, ("java", ["b", "c"])),
        ({"mix.exs": "defp deps do\n [{:phoenix, \"~> 1\"}]\nend\n{:other, 1}"}, ("elixir", ["phoenix"])),
        ({"a.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><PackageReference Include="X.Y" /></Project>'}, ("csharp", ["X.Y"])),
        ({"Package.swift": '.package(url: "https://h/vapor/vapor.git", from: "4"),\n.package(name: "N", url: "https://h/m")'}, ("swift", ["vapor", "N"])),
        ({"Cargo.toml": "[dependencies]\nactix-web = '4'\n[workspace.dependencies]\nx = '1'\n"}, ("rust", ["actix-web"])),
        ({"Cargo.toml": "[dependencies]\na = '1'\n#" + "x" * (4 << 20)}, None),
        ({}, None),
    ],
)
def test_manifests(files, want):
    assert manifests.read_manifest(files) == want


@pytest.mark.parametrize(
    ("ecosystem", "dependency", "wanted", "hit"),
    [
        ("javascript", "@nestjs/core", "@nestjs/core", True), ("javascript", "@nestjs/core-extra", "@nestjs/core", False), ("elixir", "phoenix_live_view", "phoenix", False),
        ("rust", "actix-web-extra", "actix-web", False), ("python", "Django==4.2", "django", True), ("ruby", "rails-i18n", "rails", True), ("java", "spring-boot-starter-web", "spring-boot", True),
    ],
)
def test_dependencies_match_by_ecosystem(ecosystem, dependency, wanted, hit):
    assert manifests.dependency_matches(ecosystem, dependency, wanted) == hit


def test_frameworks():
    name = lambda files: (p := manifests.framework_of(manifests.read_manifest(files))) and p.name
    assert name({"go.mod": "require github.com/gin-gonic/gin v1"}) == "Gin" and name({"go.mod": "require github.com/labstack/echo/v4 v4"}) == "Echo"
    assert name({"package.json": '{"dependencies": {"nuxt": "1"}}'}) == "Nuxt.js" and name({"package.json": '{"dependencies": {"express": "1"}}'}) is None
    assert name({"composer.json": '{"require": {"symfony/framework-bundle": "1"}}'}) == "Symfony"
    assert len(manifests.PROFILES) == 14


def test_detection_cascade():
    detect = manifests.detect_subsystems
    assert detect("r", FILES, list(FILES))[0] == {".": "root", "core": "core", "tools/cli": "cli"}
    assert detect("r", {"Cargo.toml": '[workspace]\nmembers = ["a", "b/*"]'}, ["b/c/x.rs"])[0] == {".": "root", "a": "a"}
    npm = {"package.json": '{"workspaces": ["packages/*", "ssr"]}'}
    assert detect("r", npm, ["packages/a/x.js", "packages/b/y.js", "app/z.js"])[0] == {".": "root", "packages/a": "a", "packages/b": "b", "ssr": "ssr"}
    assert set(detect("r", npm, ["packages/a/x.js", "app/z.js", "lib/z.ts", "web/q.tsx", "dist/n.js"])[0]) == {".", "packages/a", "packages", "ssr", "app", "lib", "web"}
    rails = detect("r", {"Gemfile": "gem 'rails'"}, ["app/models/a.rb", "lib/b.rb"])
    assert (rails[0], rails[1], rails[2].name) == ({"app": "app", ".": "infrastructure"}, 2, "Rails")
    django = detect("r", {"requirements.txt": "django"}, ["shop/models.py", "shop/views.py", "apps/users/models.py", "apps/users/apps.py", "venv/models.py", "venv/views.py", "x.py"])
    assert django[0] == {"shop": "shop", "apps/users": "users"}
    assert detect("r", {"requirements.txt": "django"}, ["x.py"])[0] == {}
    go = detect("r", {"go.mod": "module x"}, ["cmd/a/main.go", "pkg/b.go"])
    assert (go[0], go[2].name) == ({".": "infrastructure", "cmd": "cmd", "pkg": "pkg"}, "Go")
    js = detect("r", {"package.json": '{"dependencies": {"next": "1"}}'}, ["a/x.js", "b/deep/y.ts", "c.js", "node_modules/z.js"])
    assert (js[0], js[1], js[2].name) == ({".": "root", "a": "a", "b": "b"}, 2, "Next.js")
    assert detect("r", {}, ["pkg/__init__.py", "pkg/sub/__init__.py", "tests/t.py"])[:2] == ({"pkg": "pkg", "tests": "testing"}, 2)
    assert detect("r", {}, ["src/pkg/__init__.py"])[:2] == ({"src/pkg": "pkg"}, 1)
    assert detect("r", {}, ["src/a/x.rs", "src/b/y.rs"])[0] == {".": "root", "src/a": "a", "src/b": "b"}
    assert detect("r", {}, ["x.rs"])[0] == {".": "r"}


def test_javascript_configuration():
    assert manifests.js_config(WEB, {}) == {"aliases": [("@/*", ["src/*"])], "packages": {}, "declared": ["react"], "roots": ["src"]}
    yml = "default: &default\n  source_path: app/javascript\n  additional_paths: ['vendor/js', 'none']\nother:\n  source_path: no\n"
    got = manifests.js_config({"config/webpacker.yml": yml, "ssr/package.json": '{"name": "@o/ssr", "peerDependencies": {"p": "1"}}'}, {"ssr": "ssr"}, ["app/javascript/a.js", "vendor/js/b.js", "no/c.js"])
    assert got == {"aliases": [], "packages": {"@o/ssr": "ssr"}, "declared": ["p"], "roots": ["app/javascript", "vendor/js"]}


def test_documents(spark, tmp_path):
    root = write(tmp_path, FILES)
    docs = documents.discover(spark, root)
    assert {r.path for r in docs.collect()} == {"README.md", "docs/guide/deep.md"}
    got = {r.path: (r.taken, r.state) for r in documents.select_within_budget(docs, 40).collect()}
    assert got["README.md"] == (40, "truncated") and got["docs/guide/deep.md"] == (0, "skipped")
    s = documents.structured(docs).where("path = 'README.md'").first()
    assert (s.headings, s.terminology, s.config_values, s.decisions) == (["Title"], ["term: its meaning"], ["MODE=fast"], ["The decision was to stay small."])
    assert documents.read_text(docs, "docs/guide/deep.md") == "# Guide\n" and documents.read_text(docs, "none.md") is None


def test_settings():
    c = config.parse('{"subsystems": [{"path": "a", "name": "A"}], "exclude": ["x"], "summarizer_backend": "generic", "summarizer_input_char_budget": 10}')
    assert c.subsystems == {"a": "A"} and config.input_budget(c) == 2_000 and config.input_budget(config.RepoConfig()) == 8_000
    for bad in ("[1]", '{"summarizer_backend": "other"}', "{"):
        with pytest.raises(ConfigError):
            config.parse(bad)
