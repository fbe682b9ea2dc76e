"""python -m tessera.cli [FILE] [--show plan|term|source|refs-dot|routes-dot|types]: what a schema compiles to. Reads standard input without FILE."""

from __future__ import annotations

import argparse
import sys

from .operators.lower import storage_type
from .plans import dump
from .plans.compiler import Options, compile_schema
from .plans.simplify import BUDGET, simplify
from .plans.source import BadSchema, Library, parse


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="tessera", description=__doc__)
    a.add_argument("file", nargs="?", default="-")
    a.add_argument("--show", choices=("plan", "term", "source", "refs-dot", "routes-dot", "types"), default="plan")
    a.add_argument("--base-uri", default="")
    a.add_argument("--budget", type=int, default=BUDGET)
    args = a.parse_args(argv)
    text = sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()  # noqa: SIM115
    try:
        if args.show in ("plan", "routes-dot", "types"):
            c = compile_schema(text, Options(args.base_uri, args.budget))
            print({"plan": dump.compiled_text, "routes-dot": dump.route_dot, "types": lambda c: storage_type(c, c.plan.shape, c.plan.tests)}[args.show](c))
            return int(any(d.severity == "error" for d in c.diagnostics))
        library = Library()
        root = library.add_document(args.base_uri, parse(text))
        library.resolve()
        if args.show == "refs-dot":
            print(dump.reference_dot(library))
        else:
            term = library.term(root.key)
            print(dump.term_text(simplify(term, args.budget) if args.show == "term" else term))
    except BadSchema as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
