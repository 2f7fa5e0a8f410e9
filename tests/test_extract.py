"""Extraction against a plain-Python statement of the rules, on hand-made and generated texts."""

import json
import random
import re

from codeassay.functions.arrow_udfs import json_answer
from codeassay.operators.extract import extract, fenced

FENCE = re.compile(r"```(?:python)?\s*\n(.*?)\n```", re.DOTALL)
PATH_FIRST = re.compile(r'\{[^{}]*"file_path"[^{}]*"content"[^{}]*\}', re.DOTALL)
CONTENT_FIRST = re.compile(r'\{[^{}]*"content"[^{}]*"file_path"[^{}]*\}', re.DOTALL)


def expected_json(text):
    try:
        try:
            data = json.loads(text)
        except json.JSONDecodeError:
            found = PATH_FIRST.search(text) or CONTENT_FIRST.search(text)
            if not found:
                return None
            data = json.loads(found.group(0))
    except Exception:
        return None
    if not isinstance(data, dict):
        return None
    content, path = data.get("content", ""), data.get("file_path", "template.py")
    if not isinstance(content, str) or not content.strip() or not isinstance(path, str):
        return None
    try:  # a validated text field holds no lone surrogates
        content.encode(), path.encode()
    except UnicodeEncodeError:
        return None
    return content, path


def expected(text):
    if not text or not text.strip():
        return False, "raw_code", ""
    answer = expected_json(text)
    if answer:
        return True, "json_wrapped", answer[0]
    box = FENCE.search(text)
    if box and box.group(1).strip():
        return True, "markdown_wrapped", box.group(1).strip()
    return True, "raw_code", text.strip()


CASES = [
    'def hello():\n    return "world"\n',
    "Here's the fixed code:\n\n```python\ndef hello():\n    return 1\n```\n\nThat's it!",
    '{\n "file_path": "template.py",\n "content": "def hello():\\n    return 1"\n}',
    "",
    None,
    '{"file_path": "test.py", "content": "```python\\ndef test():\\n    pass\\n```"}',
    "```\ndef test():\n    pass\n```",
    "   \n\t ",
    "\x1c\x1d\u3000",
    "```\n\n```",
    "```\n\n```\nfoo\n```",
    "```python\n\n\n   x = 1\n\n\n```",
    "```python3\nx\n```",
    "````\ncode\n````",
    "```\ncode```",
    "text ```python   \n\t\n y = 2 \n``` more\n```\nz\n```",
    "a ```\nb ```\nc ```\n",
    '{"content": "x"} trailing',
    'see {"file_path": "t.py", "content": "x = 1"} thanks',
    'see {"content": "x = 1", "file_path": "t.py"} thanks',
    'see {"content": "late", "file_path": "t.py"} and {"file_path": "u.py", "content": "first"}',
    '{"file_path": 3, "content": "x"}',
    '{"file_path": null, "content": "x"}',
    '{"content": 5}',
    '{"content": "   "}',
    '{"\\u0063ontent": "escaped key"}',
    '{"content": "a", "content": "b"}',
    '{"content": "x", "n": NaN}',
    '{"content": "\\ud800"}',
    "[1, 2]",
    '"content"',
    '{"a": {"file_path": "t", "content": "inner"}} tail',
    '{"file_path": "t", "content": "has { brace"} tail',
    '{"file_path": "t", {"file_path": "u", "content": "ok"} }',
    " \t\n{\"content\": \"spaced\"}",
    "\ufeff{\"content\": \"bom\"}",
    "\u00a0```\ncode\n```\u00a0",
    "```\u2003\n\u2003code\n```",
    "```\r\ncode\r\n```",
]


def generated(n, seed=3):
    rng = random.Random(seed)
    bits = ["```", "```python", "\n", "\n\n", " ", "x = 1", "{", "}", '"file_path"', '"content"', ": ", '"v"', ", ", "\t", "`", "\u00a0"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_cascade_matches_rules(spark):
    texts = CASES + generated(4000)
    rows = extract(spark.createDataFrame(list(enumerate(texts)), "i int, output string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.success, row.format, row.content) == expected(texts[row.i]), repr(texts[row.i])
        assert (row.extraction_error is None) == row.success


def test_json_helper_matches_rules():
    rng = random.Random(5)
    bits = ["{", "}", '"file_path"', '"content"', ":", '"a"', ",", " ", "1"]
    for text in [c for c in CASES if c] + ["".join(rng.choices(bits, k=rng.randint(2, 16))) for _ in range(20000)]:
        got = json_answer(text)
        want = expected_json(text)
        assert (got and (got["content"], got["file_path"])) == want, text


def test_lone_surrogate_is_no_answer(spark):
    row = extract(spark.createDataFrame([('{"content": "\\ud800"}',)], "output string")).first()
    assert row.format == "raw_code"


def test_file_path_is_reported(spark):
    row = extract(spark.createDataFrame([('{"file_path": "a/b.py", "content": "x"}',)], "output string")).first()
    assert (row.format, row.file_path) == ("json_wrapped", "a/b.py")


def test_hostile_texts_finish(spark):
    """Texts on which a backtracking search would be quadratic."""
    n = 200_000
    texts = ["```" + "\n" * n, "a ```\n" * (n // 4), "{" * n + '"file_path" "content"', "x" + " " * n + "y", "```\n" + "\n " * n]
    rows = extract(spark.createDataFrame([(t,) for t in texts], "output string")).collect()
    assert [r.format for r in rows] == ["raw_code"] * len(texts)


def test_fenced_alone(spark):
    df = spark.createDataFrame([(1, "```\nx\n```"), (2, "x"), (3, "```\n\n```")], "i int, output string")
    assert {r.i: r.content for r in fenced(df).collect()} == {1: "x", 2: None, 3: None}
