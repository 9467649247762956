import ast
import importlib.util
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_queries_and_sql_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    numbers = range(1, 11) if importlib.util.find_spec("meshwright.llm") else range(1, 6)
    for n in numbers:
        assert any(q.startswith(f"p{n}_") for q in queries)


def test_nothing_imports_the_llm_subpackage():
    for path in (ROOT / "meshwright").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
