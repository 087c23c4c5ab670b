"""Compare every query with its SQL: python tests/check_all.py [sf_dir] [name part]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import differences, duck, kinds

from moveatlas.catalog import all_oracles, all_queries
from moveatlas.session import local_session

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
part = sys.argv[2] if len(sys.argv) > 2 else ""
spark = local_session("check", 8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf_dir)
oracles = all_oracles()
failed = []
for name, build in all_queries().items():
    if part not in name:
        continue
    started = time.time()
    try:
        got = build(spark, sf_dir).toPandas()
        note = "rows only"
        if name in oracles:
            want = con.execute(oracles[name]).fetchdf()
            found = differences(got, want)
            note = "ok" if found is None else f"DIFFERENT: {found}"
            if found is None and kinds(got) != kinds(want):
                note += f" (types {[(c, kinds(got)[c], kinds(want)[c]) for c in kinds(got) if kinds(got)[c] != kinds(want)[c]]})"
            if found:
                failed.append(name)
    except Exception as error:
        note = f"ERROR: {type(error).__name__}: {str(error)[:600]}"
        failed.append(name)
        got = ()
    print(f"{name:40s} {time.time() - started:6.2f}s rows={len(got):6d} {note}", flush=True)
print("failed:", failed)
sys.exit(bool(failed))
