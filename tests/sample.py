"""A small repository of several languages, written for these tests."""

FILES = {
    "Cargo.toml": '[workspace]\nmembers = ["core", "tools/cli"]\n',
    "core/Cargo.toml": '[package]\nname = "core"\n[dependencies]\nserde = "1"\n',
    "core/src/lib.rs": "pub mod store;\npub mod walk;\nuse crate::store::open;\n\npub fn start(n: u32) -> u32 {\n    if n > 2 { return open(n); }\n    for i in 0..n { walk::step(i); }\n    0\n}\n",
    "core/src/store.rs": "use super::walk::step;\n\npub struct Store { a: u8 }\n\npub fn open(n: u32) -> u32 {\n    match n { 0 => 1, _ => step(n) }\n}\n\n#[cfg(test)]\nmod tests {\n    fn checks_open() { super::open(1); }\n}\n",
    "core/src/walk.rs": "pub fn step(n: u32) -> u32 {\n    let s = \"{ not a brace\"; // { nor here\n    while n > 1 { break; }\n    n\n}\n",
    "tools/cli/Cargo.toml": '[package]\nname = "cli"\n',
    "tools/cli/src/main.rs": "use core::store::open;\n\nfn main() {\n    open(3);\n}\n",
    "tools/cli/tests/run_test.rs": "fn runs() { }\n",
    "README.md": "# Title\nterm: its meaning\nMODE=fast\nThe decision was to stay small.\n",
    "docs/guide/deep.md": "# Guide\n",
}

WEB = {
    ".ignore": "# not ours\nnode_modules/\n*.gen.js\n!keep.gen.js\n",
    "src/lib/.ignore": "/made\n",
    "src/lib/made/x.js": "export function made() {}\n",
    "src/lib/a.gen.js": "export function gen() {}\n",
    "src/lib/keep.gen.js": "export function keep() {}\n",
    "package.json": '{"name": "web", "dependencies": {"react": "1"}}',
    "tsconfig.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["src/*"]}}}',
    "src/app/index.ts": "import { helper } from '../lib/helper';\nimport Button from '@/ui/button';\nimport React from 'react';\n\nexport const run = async (a: number) => {\n  if (a) { helper(a); }\n  return a ? 1 : 2;\n};\n",
    "src/lib/helper.ts": "export function helper(x) { for (const i of x) { other(i); } }\nexport function other(y) { try { y(); } catch (e) { } }\n",
    "src/ui/button.tsx": "export const Button = memo((p) => { return p.x; });\nexport class Panel { }\n",
    "src/only/imports.js": "import '../lib/helper';\n",
    "node_modules/x/index.js": "export function hidden() {}\n",
    "py/pkg/__init__.py": "",
    "py/pkg/tool.py": "from . import other\nimport os\n\n\nclass Tool:\n    \"\"\"A tool.\"\"\"\n\n    def go(self, n):\n        if n:\n            return other.help_me(n)\n        return [x for x in range(n)]\n",
    "py/pkg/other.py": "def help_me(n):\n    try:\n        return n\n    except ValueError:\n        return None\n",
    "go/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.org/go/helper"\n)\n\nfunc main() {\n\tfor i := 0; i < 3; i++ {\n\t\tif i > 1 {\n\t\t\tfmt.Println(i)\n\t\t}\n\t}\n\tHelp()\n}\n',
    "go/helper.go": "package main\n\nfunc Help() int { return 1 }\n",
}


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)
