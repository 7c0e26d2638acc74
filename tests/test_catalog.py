"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.plans import catalog, catalog_more, catalog_reviews, catalog_sources, catalog_text  # noqa: F401
from lodestone.plans.registry import CATALOG
from lodestone.plans.views import TABLES, with_views


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def brute_delta(duck, cols):
    """Alert deltas by looking at all leftovers of a rule and file, one after another."""
    sides = []
    for side in ("alerts_before", "alerts_after"):
        sql = with_views(f"SELECT concat('semgrep:', {catalog._FP}) AS id, rule_id, file_path, start_line, message, severity, suppressed FROM {side} ORDER BY id, severity, suppressed, message", side)
        first = {}
        for r in duck.execute(sql).fetchall():
            first.setdefault(r[0], r)
        sides.append(first)
    before, after = sides
    out = [{"change": "unchanged", "alert_id": k, "before_id": k, "change_type": None} for k in after if k in before]
    left = [r for k, r in sorted(after.items()) if k not in before]
    for k, o in sorted(before.items()):
        if k in after:
            continue
        pick = next((c for c in left if c[1:3] == o[1:3] and (abs(c[3] - o[3]) <= 5 or c[4] != o[4])), None)
        if pick is None:
            out.append({"change": "disappeared", "alert_id": k, "before_id": k, "change_type": None})
            continue
        left.remove(pick)
        kind = "severity_changed" if o[5] != pick[5] else "suppression_changed" if o[6] != pick[6] else "message_changed" if o[4] != pick[4] else "location_shifted"
        out.append({"change": "changed", "alert_id": pick[0], "before_id": k, "change_type": kind})
    out += [{"change": "appeared", "alert_id": c[0], "before_id": None, "change_type": None} for c in left]
    return sorted((tuple(r[c] for c in cols) for r in out), key=repr)


#: Queries that SQL does not express, against results made row by row.
BRUTE = {"jon07_sarif_delta": brute_delta}


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, duck, sf, name):
    q = CATALOG[name]
    df = q.run(spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if q.oracle is None:
        assert rows == BRUTE[name](duck, cols)
        return
    got = duck.execute(q.oracle)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr
