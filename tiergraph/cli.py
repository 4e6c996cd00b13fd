"""A thin command line: ``python -m tiergraph.cli --root FOLDER COMMAND ...``; ``--json`` prints NDJSON."""

from __future__ import annotations

import argparse
import sys

from tiergraph.errors import GraphError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tiergraph")
    p.add_argument("--root", required=True)
    p.add_argument("--project")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(a) for a in args]][0]
    add("create-project", "name")
    add("add-repo", "path")
    add("refresh").add_argument("--full", action="store_true")
    for name in ("projects", "repos", "subsystems", "entities", "conventions", "insights", "flows", "hotspots", "relationships", "doctor"):
        add(name)
    for name in ("entity", "children", "deps", "dependents", "blast"):
        add(name, "id")
    add("impact").add_argument("paths", nargs="+")
    add("search", "query")
    add("explore", "query")
    add("bundle", "scope")
    return p


def run(graph, args) -> None:
    from tiergraph import output

    show = lambda df, kind=None, cols=None: print("\n".join(output.lines(df, kind)) if args.json and kind else output.plain(df, cols))
    c, project = args.command, args.project
    if c == "create-project":
        print(graph.create_project(args.name))
    elif c == "add-repo":
        print(graph.add_repo(args.path, project))
    elif c == "refresh":
        print(graph.ensure_fresh(project, args.full))
    elif c == "doctor":
        print("\n".join(f"{k}: {v}" for k, v in graph.doctor().items()))
    elif c in ("projects", "repos"):
        show(graph.list_projects() if c == "projects" else graph.list_repos(project), cols=["id", "name"])
    elif c in ("subsystems", "entities"):
        show(getattr(graph, c)(project), "entities", ["id", "tier", "name", "path"])
    elif c in ("conventions", "insights"):
        show(getattr(graph, c)(project), c, output.FIELDS[c][:4])
    elif c == "relationships":
        show(graph.relationships(project), "relationships", output.FIELDS["relationships"])
    elif c == "entity":
        print(graph.entity(args.id).asDict())
    elif c == "children":
        show(graph.files_in(args.id), "entities", ["id", "tier", "name"])
    elif c in ("deps", "dependents"):
        rows = graph.dependencies_of(args.id) if c == "deps" else graph.dependents_of(args.id)
        show(rows, "relationships", output.FIELDS["relationships"])
    elif c == "impact":
        show(graph.impact(args.paths, project), "impact")
    elif c == "blast":
        show(graph.blast_radius(args.id, project))
    elif c == "bundle":
        show(graph.bundle(args.scope, project))
    elif c in ("search", "explore"):
        show(getattr(graph, c)(args.query, project), "entities" if c == "search" else None, ["id", "path"])
    else:
        show(getattr(graph, c)(project))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from tiergraph.api import open_graph
    from tiergraph.session import session

    try:
        run(open_graph(session(), args.root), args)
    except GraphError as e:
        print(e.envelope() if args.json else f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
