"""python -m rillhouse.jobs NAME ROOT [FORMAT [KEY=VALUE ...]]: one program, restarted from its checkpoint if it fails."""

from __future__ import annotations

import sys

from ..runtime import session
from ..streaming.sinks import EVERY, supervise
from . import PROGRAMS, Places


def main(args: list[str]) -> None:
    if len(args) < 2 or args[0] not in PROGRAMS:
        sys.exit(f"{__doc__}\n{' '.join(PROGRAMS)}")
    spark = session(args[0])
    places = Places(args[1], args[2] if len(args) > 2 else "kafka", dict(x.split("=", 1) for x in args[3:]), EVERY)
    if args[0] == "serving_http":
        PROGRAMS[args[0]](spark, places).serve_forever()
    else:
        supervise(lambda: PROGRAMS[args[0]](spark, places))


if __name__ == "__main__":
    main(sys.argv[1:])
