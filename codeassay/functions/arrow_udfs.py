"""The three Arrow UDFs, for semantics no built-in expression has.

Each one is a thin per-value helper around a Python standard-library grammar (``json``, ``ast``,
``difflib``). Null input gives null output at once, so callers gate rows by passing null.
"""

from __future__ import annotations

import ast
import difflib
import json
import re
import warnings

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from codeassay.schemas import DEFAULT_FILE_PATH, DIFF_STATS, JSON_ANSWER, SYNTAX_AUDIT

_BRACE_FREE_OBJECT = re.compile(r"\{([^{}]*)\}")


def _embedded_object(text: str) -> str | None:
    """First brace-free object holding both keys; path before content wins over the reverse.

    Linear: brace-free bodies are disjoint, and each is searched once per order.
    """
    for first, second in (('"file_path"', '"content"'), ('"content"', '"file_path"')):
        for found in _BRACE_FREE_OBJECT.finditer(text):
            body = found.group(1)
            at = body.find(first)
            if at >= 0 and body.find(second, at + len(first)) >= 0:
                return found.group(0)
    return None


def json_answer(text: str) -> dict | None:
    """Content and file path of a JSON-wrapped answer, or None when the text is not one."""
    try:
        try:
            data = json.loads(text)
        except json.JSONDecodeError:
            candidate = _embedded_object(text)
            if candidate is None:
                return None
            data = json.loads(candidate)
        if not isinstance(data, dict):
            return None
        content, path = data.get("content", ""), data.get("file_path", DEFAULT_FILE_PATH)
        if not isinstance(content, str) or not isinstance(path, str) or not content.strip():
            return None
        # lone surrogates are no valid text
        content.encode("utf-8"), path.encode("utf-8")
    except Exception:
        return None
    return {"content": content, "file_path": path}


def _module_level(body: list[ast.stmt]):
    """Statements that run when the module does: everything but function bodies."""
    pending = list(reversed(body))
    while pending:
        node = pending.pop()
        yield node
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        inner = [s for s in ast.iter_child_nodes(node) if isinstance(s, (ast.stmt, ast.excepthandler, ast.match_case))]
        pending.extend(reversed(inner))


def _import_roots(tree: ast.Module) -> list[str]:
    roots: dict[str, None] = {}
    for node in _module_level(tree.body):
        if isinstance(node, ast.Import):
            for alias in node.names:
                roots.setdefault(alias.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            # a relative import has no resolvable root outside a package
            roots.setdefault("." if node.level else node.module.split(".")[0])
    return list(roots)


def syntax_verdict(code: str) -> dict:
    """Parse only; nothing is compiled or run."""
    verdict = {"passed": False, "line_number": None, "error_message": "", "lines_of_code": None, "import_roots": []}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
        verdict.update(passed=True, lines_of_code=len(code.splitlines()), import_roots=_import_roots(tree))
    except IndentationError as e:
        verdict.update(line_number=e.lineno, error_message=f"Line {e.lineno}: Indentation error")
    except SyntaxError as e:
        verdict.update(line_number=e.lineno, error_message=f"Line {e.lineno}: {e.msg}")
    except Exception as e:
        verdict.update(error_message=str(e))
    return verdict


def diff_stats(old: str, new: str) -> dict:
    """Line-diff measures of one replacement. Blocks and hunks come from a single matcher run."""
    before, after = old.splitlines(), new.splitlines()
    matcher = difflib.SequenceMatcher(None, before, after)
    changed = added = deleted = shown = 0
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag != "equal":
            changed += max(i2 - i1, j2 - j1)
            # lines whose diff form looks like a file header are not counted
            deleted += sum(not line.startswith("--") for line in before[i1:i2])
            added += sum(not line.startswith("++") for line in after[j1:j2])
    if changed:
        hunks = list(matcher.get_grouped_opcodes(3))
        shown = 2 + len(hunks)
        for tag, i1, i2, j1, j2 in (block for hunk in hunks for block in hunk):
            shown += i2 - i1 if tag == "equal" else (i2 - i1) + (j2 - j1)
    return {
        "lines_changed": changed,
        "lines_added": added,
        "lines_deleted": deleted,
        "diff_lines": shown,
        "original_line_count": len(before),
        "modified_line_count": len(after),
    }


def _struct_array(rows: list, schema) -> pa.Array:
    return pa.array(rows, type=to_arrow_type(schema))


@arrow_udf(JSON_ANSWER)
def json_answer_udf(text: pa.Array) -> pa.Array:
    return _struct_array([None if v is None else json_answer(v) for v in text.to_pylist()], JSON_ANSWER)


@arrow_udf(SYNTAX_AUDIT)
def syntax_verdict_udf(code: pa.Array) -> pa.Array:
    return _struct_array([None if v is None else syntax_verdict(v) for v in code.to_pylist()], SYNTAX_AUDIT)


@arrow_udf(DIFF_STATS)
def diff_stats_udf(old: pa.Array, new: pa.Array) -> pa.Array:
    pairs = zip(old.to_pylist(), new.to_pylist())
    return _struct_array([None if a is None or b is None else diff_stats(a, b) for a, b in pairs], DIFF_STATS)
