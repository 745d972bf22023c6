import ast
import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.records for r in rows) == 200 and set(rows[0].asDict()) == {"partition_id", "records", "with_code", "latest_added_ms", "code_percent"}


def test_every_registry_query_has_sql():
    from tarnloom import queries

    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_it_works_without_the_llm_package():
    code = "import sys; sys.modules['tarnloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert n and e.oracle_sql() and not any(x.startswith('op') or x == 'pipeline' for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_llm_package():
    for path in [*ROOT.glob("tarnloom/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path
