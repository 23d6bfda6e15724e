"""python -m minutario list | run QUERY FOLDER [OUT] | sql QUERY"""

from __future__ import annotations

import sys

from minutario.plans import registry
from minutario.session import local_session


def main(args: list[str]) -> int:
    if args[:1] == ["list"] and len(args) == 1:
        print("\n".join(sorted(registry.queries())))
        return 0
    if args[:1] == ["sql"] and len(args) == 2 and args[1] in registry.oracle_sql():
        print(registry.oracle_sql()[args[1]])
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4) and args[1] in registry.queries():
        df = registry.queries()[args[1]](local_session(), args[2])
        if len(args) == 4:
            df.write.mode("errorifexists").parquet(args[3])
        else:
            df.show(20, truncate=80)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
