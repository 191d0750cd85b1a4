"""Report columns whose value kinds differ between a query and its oracle (developer tool)."""
import sys

import oracle as o

import __spark_entry__ as entry
from reviewlake.session import local_session

sf = sys.argv[1]
spark, con = local_session(), o.connect(sf)
for name, sql in entry.oracle_sql().items():
    if sys.argv[2:] and name not in sys.argv[2:]:
        continue
    df, rel = entry.queries()[name](spark, sf), con.sql(sql)
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    kind = lambda t: ("int" if "int" in t.lower() or t == "long" else "float" if t.lower().startswith(("double", "decimal", "float"))
                      else "text" if t.lower() in ("string", "varchar") else "ts" if t.lower().startswith("timestamp") else t.lower())
    bad = {c: (mine[c], theirs[c]) for c in mine if kind(mine[c]) != kind(theirs[c]) or "HUGE" in theirs[c]}
    if bad:
        print(name, bad, flush=True)
