"""Command line: ``python -m meshloom doctor`` tells what is installed; ``queries`` lists the registered ones."""

from __future__ import annotations

import argparse
import json


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="meshloom")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("doctor", help="what is installed; nothing is run")
    check.add_argument("--json", action="store_true")
    check.add_argument("--require", action="append", default=[])
    commands.add_parser("queries", help="names of the registered queries")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "queries":
        from meshloom.plans.registry import queries

        print("\n".join(sorted(queries())))
        return 0
    from meshloom.operators.specs import doctor

    found = doctor(frozenset(args.require))
    if args.json:
        print(json.dumps(found, sort_keys=True))
    else:
        for c in found:
            print(f"{c['name']:10} {'ok' if c['available'] else 'missing':8} {c['detail']}")
    return int(any(c["required"] and not c["available"] for c in found))


if __name__ == "__main__":
    raise SystemExit(main())
