"""``python -m brisa KIND [TEXT]``: standardizes the text, or every line of standard input."""

from __future__ import annotations

import sys

from brisa.functions.scalars import OTHERS, SCALARS


def main(args: list[str]) -> int:
    known = SCALARS | OTHERS
    if not args or args[0] not in known:
        print(f"usage: python -m brisa KIND [TEXT]; kinds: {', '.join(known)}", file=sys.stderr)
        return 2
    lines = [" ".join(args[1:])] if len(args) > 1 else (line.rstrip("\n") for line in sys.stdin)
    for line in lines:
        print(known[args[0]](line))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
