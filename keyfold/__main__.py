"""``python -m keyfold get|set|delete --path FOLDER KEY [VALUE]``. Exit codes: 0 done, 1 no such key, 2 error."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="keyfold")
    p.add_argument("--path", required=True)
    p.add_argument("--node", default="node-01")
    sub = p.add_subparsers(dest="do", required=True)
    for name, more in (("get", ()), ("set", ("value",)), ("delete", ())):
        s = sub.add_parser(name)
        for a in ("key", *more):
            s.add_argument(a)
    args = p.parse_args(argv)
    try:
        from keyfold.session import local_session
        from keyfold.store import KVStore

        kv = KVStore(local_session(2, 2), args.path, args.node)
        if args.do == "set":
            kv.set(args.key, args.value.encode())
            print("OK")
            return 0
        if args.do == "get":
            value = kv.get(args.key)
            if value is None:
                print("key not found", file=sys.stderr)
                return 1
            sys.stdout.write(value.decode(errors="replace") + "\n")
            return 0
        if kv.delete(args.key):
            print("deleted")
            return 0
        print("key not found", file=sys.stderr)
        return 1
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
