"""SQL counterparts of the catalog queries, for DuckDB on the same tables.

They are written from the documented semantics, with plain windows, joins and regexes, and do not
share expressions with the Spark operators; only the corpus views are common.
"""

from __future__ import annotations

from codeassay.plans import corpus
from codeassay.schemas import DEFAULT_RULES, FAILURE_CATEGORIES, FAILURE_MODES, NO_FAILURE

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    """SQL text literal; newlines become chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


def has(col: str, *needles: str) -> str:
    return "(" + " or ".join(f"contains({col}, {text(n)})" for n in needles) + ")"


def with_views(views: dict[str, str], body: str) -> str:
    return "with " + ", ".join(f"{name} as ({sql})" for name, sql in views.items()) + " " + body


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TEMPLATE = text(corpus.TEMPLATE)

# ---------------------------------------------------------------------------
# Extraction
# ---------------------------------------------------------------------------

_PATH_FIRST = r"""'\{[^{}]*"file_path"[^{}]*"content"[^{}]*\}'"""
_CONTENT_FIRST = r"""'\{[^{}]*"content"[^{}]*"file_path"[^{}]*\}'"""
_CANDIDATE = f"""select *, case when json_valid(output) then output else
  coalesce(nullif(regexp_extract(output, {_PATH_FIRST}), ''), nullif(regexp_extract(output, {_CONTENT_FIRST}), ''))
  end as candidate from """
_JSON = """select *, case when json_valid(candidate) and json_type(candidate) = 'OBJECT'
    and json_type(candidate, '$.content') = 'VARCHAR'
    and coalesce(json_type(candidate, '$.file_path'), 'VARCHAR') = 'VARCHAR'
    then json_extract_string(candidate, '$.content') end as json_content,
  coalesce(json_extract_string(case when json_valid(candidate) and json_type(candidate) = 'OBJECT' then candidate end,
    '$.file_path'), 'template.py') as json_path
  from candidates"""
_FENCED = rf"nullif(trim(regexp_extract(output, '```(?:python)?\s*\n(.*?)\n```', 1, 's'), {WS}), '')"


def extraction(source: str) -> dict[str, str]:
    return {
        "candidates": _CANDIDATE + source,
        "answered": _JSON,
        "extracted": f"""select *,
  case when blank then '' when json_content is not null then json_content
       when fenced is not null then fenced else trim(output, {WS}) end as content,
  not blank as success,
  case when blank then 'raw_code' when json_content is not null then 'json_wrapped'
       when fenced is not null then 'markdown_wrapped' else 'raw_code' end as format,
  case when not blank and json_content is not null then json_path else 'template.py' end as file_path,
  case when blank then 'Empty output from model' end as extraction_error
  from (select * exclude (json_content), nullif(json_content, '') as json_content, {_FENCED} as fenced,
    coalesce(trim(output, {WS}) = '', true) as blank from answered) a""",
    }


RESPONSES = {"responses": corpus.RESPONSES_SQL}
EXTRACTED = {**RESPONSES, **extraction("responses")}

ORACLES["extract_json"] = with_views(
    EXTRACTED,
    """select response_id, content, file_path from extracted where format = 'json_wrapped'""",
)
ORACLES["extract_fenced"] = with_views(
    RESPONSES,
    f"select response_id, {_FENCED} as content from responses where {_FENCED} is not null",
)
ORACLES["extract_cascade"] = with_views(
    EXTRACTED,
    "select response_id, success, format, content, file_path, extraction_error from extracted",
)
ORACLES["format_mix"] = with_views(
    EXTRACTED,
    """select model, format, count(*) as responses, count(*) filter (not success) as parse_failures,
    round(count(*) / sum(count(*)) over (partition by model), 6) as share
    from extracted group by model, format""",
)

# ---------------------------------------------------------------------------
# Features and scores
# ---------------------------------------------------------------------------


def features(signature: str) -> str:
    return rf"""contains(content, {signature}) as signature_compliance,
  len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(string_split(l, '#')[1], '^\s*class\s+\w+'))) = 0
    as no_class_introduction,
  not regexp_matches(content, 'def\s+generate_user_report\s*\(\s*self') as no_self_parameter,
  regexp_matches(content, 'set\s*\(') or regexp_matches(content, 'in\s+seen') as deduplication,
  regexp_matches(content, '\.sort\s*\(') or regexp_matches(content, 'sorted\s*\(') as sorting_active_users,
  regexp_matches(content, 'len\s*\(\s*active') and regexp_matches(content, 'len\s*\(\s*inactive') as correct_counts,
  regexp_matches(content, 'isinstance\s*\(') as robust_input_handling,
  regexp_matches(content, '\.join\s*\(') or regexp_matches(content, 'return\s+f''') or regexp_matches(content, 'return\s+f"')
    as string_return_format"""


def raw_score(weight: dict[str, str]) -> str:
    parts = [
        f"case when {'not ' if kind == 'penalty' else ''}{rule} then {weight[rule]} else 0 end"
        for rule, (kind, *_) in DEFAULT_RULES.items()
    ]
    return "10 + " + " + ".join(parts)


DEFAULT_WEIGHTS = {rule: str(weight) for rule, (_, weight, _) in DEFAULT_RULES.items()}
SIGNATURE = text("def generate_user_report(users)")
# a failed extraction leaves no file and scores 0
FEATURED = {
    **EXTRACTED,
    "featured": f"select response_id, content, success, {features(SIGNATURE)} from extracted where success",
    "scored": f"""select e.response_id, cast(case when f.response_id is null then 0 else {raw_score(DEFAULT_WEIGHTS)} end as int) as raw_score,
      f.signature_compliance, f.no_class_introduction, f.no_self_parameter
      from (select response_id from extracted) e left join featured f on f.response_id = e.response_id""",
}
ORACLES["compliance_features"] = with_views(
    FEATURED, f"select response_id, {', '.join(DEFAULT_RULES)} from featured"
)
ORACLES["compliance_score"] = with_views(
    FEATURED,
    "select response_id, raw_score, greatest(0, least(10, raw_score)) as compliance_score from scored",
)
ORACLES["threshold_pass"] = with_views(
    FEATURED,
    """select response_id, greatest(0, least(10, raw_score)) as compliance_score from scored
    where greatest(0, least(10, raw_score)) >= 7
      and signature_compliance and no_class_introduction and no_self_parameter""",
)

_MODE_TESTS = {
    "signature_parameter_mismatch": f"not {has('o', 'def generate_user_report(users)')} and {has('o', 'def generate_user_report(')}",
    "completely_different_name": f"not {has('o', 'def generate_user_report(')} and {has('o', 'def ')}",
    "no_function_definition": f"not {has('o', 'def ')}",
    "class_introduction": has("o", "class "),
    "self_parameter_oop": has("o", "def generate_user_report(self"),
    "file_io_hallucination": has("o", "open(", ".txt", ".csv"),
    "external_dependency_datetime": has("o", "import datetime", "from datetime"),
    "suspicious_external_imports": f"{has('o', 'import ')} and not {has('o', 'collections')} and not {has('o', 'operator')}",
    "returns_dict_not_string": has("o", "return {", "return dict"),
    "returns_non_string_iterable": has("o", "return [", "return ("),
    "no_deduplication": f"not {has('o', 'seen')} and not {has('o', 'set()')}",
    "no_sorting": f"not {has('o', 'sort')}",
    "no_active_inactive_separation": f"not ({has('o', 'active')} and {has('o', 'inactive')})",
}
_MODE_LIST = "list_filter([" + ", ".join(f"case when {_MODE_TESTS[m]} then '{m}' end" for m in FAILURE_MODES) + "], lambda m: m is not null)"
MODED = {
    **RESPONSES,
    "moded": f"""select response_id, model, run, error,
      case when len(found) = 0 then ['{NO_FAILURE}'] else found end as modes
      from (select *, {_MODE_LIST} as found from (select *, coalesce(output, '') as o from responses) r) q""",
    "mode_rows": "select unnest(modes) as mode from moded where error is null",
    "mode_counts": "select mode, count(*) as n from mode_rows group by mode",
}
ORACLES["failure_modes"] = with_views(
    MODED, "select response_id, array_to_string(modes, '|') as failure_modes from moded"
)
ORACLES["failure_mode_distribution"] = with_views(
    MODED,
    """select mode, n as occurrences,
    round(n * 100.0 / (select count(*) from moded where error is null), 6) as percent from mode_counts""",
)
_CATEGORY_ROWS = ", ".join(f"('{c}', '{m}')" for c, modes in FAILURE_CATEGORIES.items() for m in modes)
ORACLES["failure_category_rollup"] = with_views(
    MODED,
    f"""select category, cast(coalesce(sum(n), 0) as bigint) as failures
    from (values {_CATEGORY_ROWS}) as c(category, mode) left join mode_counts using (mode) group by category""",
)

QUICK = {
    **RESPONSES,
    "facts": f"""select *, {has('o', 'def generate_user_report(users)')} as signed, {has('o', 'def generate_user_report(self')} as selfed,
      {has('o', 'class ')} as classy, {has('o', 'self.')} as selfrefs, {has('o', 'seen', 'set()')} as dedups,
      {has('o', 'sort')} as sorts, ({has('o', 'active')} and {has('o', 'inactive')}) as separates,
      {has('o', 'isinstance', 'None', 'type(')} as guards, {has('o', 'return "', "return '", '.join(')} as texty
      from (select *, coalesce(output, '') as o from responses) r""",
    "quick": """select response_id, model, run, error, latency_ms,
      cast(case when o = '' then 0 else greatest(0, least(10,
        case when selfed then -3 when not signed then -2 else 1 end
        - case when classy then 2 else 0 end - case when selfrefs and selfed then 2 else 0 end
        + case when dedups then 2 else 0 end + case when sorts then 2 else 0 end
        + case when separates then 2 else 0 end + case when guards then 1 else 0 end
        + case when texty then 1 else 0 end)) end as int) as score,
      (o <> '' and signed and not selfed and not classy) as is_compliant,
      case when o = '' then ['No output generated'] else list_filter([
        case when selfed then 'CRITICAL: Function has ''self'' parameter (introduced class method)' end,
        case when not selfed and not signed then 'WARNING: Function signature does not match required ''generate_user_report(users)''' end,
        case when classy then 'CRITICAL: Code introduces unnecessary class definition (violates standalone requirement)' end,
        case when selfrefs and selfed then 'CRITICAL: Function converted to instance method with ''self'' references' end,
        case when not dedups then 'Missing deduplication logic' end,
        case when not sorts then 'Missing sorting logic for active users' end,
        case when not separates then 'Missing active/inactive user separation' end,
        case when not texty then 'May not return string format (check return statements)' end
      ], lambda i: i is not null) end as issues from facts""",
}
ORACLES["quick_score"] = with_views(
    QUICK,
    "select response_id, score, 10 as max_score, score / 10.0::double as normalized, is_compliant from quick",
)
ORACLES["compliance_issues"] = with_views(
    QUICK, "select response_id, array_to_string(issues, '|') as compliance_issues from quick"
)
ORACLES["token_estimate"] = with_views(
    {"prompted": corpus.PROMPTED_SQL},
    """select response_id, cast((coalesce(length(prompt), 0) + coalesce(length(output), 0)) // 4 as int) as tokens
    from prompted""",
)

# ---------------------------------------------------------------------------
# Batch statistics
# ---------------------------------------------------------------------------

ORACLES["error_exclusion"] = with_views(
    RESPONSES, "select response_id, model, run, latency_ms from responses where error is null"
)
ORACLES["compliance_rate"] = with_views(
    QUICK,
    """select count(*) as total_runs, count(*) filter (is_compliant) as compliant,
    round(count(*) filter (is_compliant) * 100.0 / count(*), 6) as compliant_rate,
    count(*) filter (not is_compliant) as non_compliant,
    round(100.0 - round(count(*) filter (is_compliant) * 100.0 / count(*), 6), 6) as non_compliant_rate
    from quick where error is null""",
)
ORACLES["score_distribution"] = with_views(
    QUICK,
    """select model, count(*) as runs, round(avg(score), 6) as mean_score,
    list_sort(list(score))[count(*) // 2 + 1] as median_score,
    min(score) as min_score, max(score) as max_score, round(stddev_pop(score), 6) as stddev_score
    from quick where error is null group by model""",
)
ORACLES["batch_summary"] = with_views(
    {**MODED, **{k: v for k, v in QUICK.items() if k != "responses"}},
    """select count(*) as total_runs, round(count(*) filter (is_compliant) * 100.0 / count(*), 6) as compliant_rate,
    'qwen2.5-coder|llama3|mistral' as registered_models, round(avg(score), 6) as mean_score,
    (select string_agg(mode || '=' || cast(n as varchar), '|' order by mode || '=' || cast(n as varchar)) from mode_counts)
      as failure_modes from quick where error is null""",
)
ORACLES["batch_results_roundtrip"] = with_views(
    {**MODED, **{k: v for k, v in QUICK.items() if k != "responses"}},
    """select 'b1' as batch_id, q.response_id, q.run, q.model, q.score, array_to_string(m.modes, '|') as failure_modes
    from quick q join moded m on m.response_id = q.response_id where q.error is null""",
)
_GRID = """select cast(r.n as int) as run, m.model
  from (select unnest(range(1, (select max(run) from {rows}) + 1)) as n) r
  cross join (values ('qwen2.5-coder'), ('llama3'), ('mistral')) as m(model)"""
ORACLES["evaluation_grid"] = with_views(
    {**RESPONSES, "grid": _GRID.format(rows="responses")},
    """select g.run, g.model, count(r.response_id) as responses from grid g
    left join responses r on r.run = g.run and r.model = g.model and r.error is null group by g.run, g.model""",
)
ORACLES["missing_cells"] = with_views(
    {**RESPONSES, "grid": _GRID.format(rows="responses")},
    """select run, model from grid g
    where not exists (select 1 from responses r where r.run = g.run and r.model = g.model and r.error is null)""",
)
ORACLES["model_routing"] = """select event_id, case when preferred in ('qwen2.5-coder', 'llama3', 'mistral') then preferred
  else ['qwen2.5-coder', 'llama3', 'mistral'][cast(index % 3 as int) + 1] end as model
  from (select event_id, user_id as index,
    case event_id % 4 when 0 then 'llama3' when 1 then event_type end as preferred from events) r"""

# ---------------------------------------------------------------------------
# Sources
# ---------------------------------------------------------------------------

_BAD = "problems <> ''"
SPECS = {
    "specs": corpus.SPECS_SQL,
    "docs": "select folder, spec_text, case when json_valid(spec_text) then spec_text end as doc from specs",
    "checked": "select *, case when doc is null then 'invalid_json' when json_type(doc) <> 'OBJECT' then 'not_an_object' else "
    "concat_ws('|', "
    + ", ".join(
        f"case when json_type(doc, '$.{f}') is null then 'missing:{f}' when json_type(doc, '$.{f}') <> 'VARCHAR' then 'invalid:{f}' end"
        for f in ("task_id", "name", "category", "difficulty", "workflow")
    )
    + ", "
    + ", ".join(
        f"case when json_type(doc, '$.{f}') not in ('UBIGINT', 'BIGINT') then 'invalid:{f}' end"
        for f in ("execution_config.max_iterations", "execution_config.timeout_seconds", "evaluation.max_score")
    )
    + ") end as problems from docs",
    "objects": "select *, case when json_type(doc) = 'OBJECT' then doc end as o from checked",
    "rule_maps": "select folder, problems, o, json_extract(o, '$.evaluation.scoring_rules') as given from objects",
}
ORACLES["spec_conformance"] = with_views(
    SPECS,
    """select folder, case when problems = '' then 'valid' else 'reject' end as status, problems,
    coalesce(folder <> json_extract_string(o, '$.task_id'), false) as id_mismatch,
    coalesce(json_extract_string(o, '$.language'), 'python') as language,
    coalesce(try_cast(json_extract_string(o, '$.execution_config.max_iterations') as int), 3) as max_iterations,
    coalesce(try_cast(json_extract_string(o, '$.execution_config.timeout_seconds') as int), 60) as timeout_seconds,
    'syntax|imports|tests' as validation_order,
    cast(coalesce(len(json_keys(o, '$.evaluation.scoring_rules')), 0) as int) as n_rules from objects""",
)
_RULE_ROWS = ", ".join(
    f"({text(rule)}, '{kind}', {weight}, {text(check)})" for rule, (kind, weight, check) in DEFAULT_RULES.items()
)
RULES = {
    **SPECS,
    "rules": f"""select m.folder as task_id, d.rule, d.kind,
      cast(coalesce(try_cast(json_extract_string(m.given, '$.' || d.rule || case when d.kind = 'penalty'
        then '.penalty_if_violated' else '.points' end) as int), d.weight) as int) as weight,
      coalesce(json_extract_string(m.given, '$.' || d.rule || '.check_for'), d.check_for) as check_for
      from (select * from rule_maps where problems = '') m
      cross join (values {_RULE_ROWS}) as d(rule, kind, weight, check_for)""",
}
ORACLES["rules_effective"] = with_views(
    RULES,
    """select case when json_extract_string(o, '$.task_id') is null then task_id else json_extract_string(o, '$.task_id') end
      as task_id, rule, kind, weight, check_for
      from rules join (select folder, o from rule_maps) m on m.folder = rules.task_id""",
)
WIDE_RULES = {
    **RULES,
    "wide": "select task_id, max(check_for) filter (rule = 'signature_compliance') as sig, "
    + ", ".join(f"max(weight) filter (rule = '{r}') as w_{r}" for r in DEFAULT_RULES)
    + " from (select coalesce(json_extract_string(m.o, '$.task_id'), r.task_id) as task_id, rule, weight, check_for"
    " from rules r join rule_maps m on m.folder = r.task_id) q group by task_id",
}
ORACLES["compliance_score_by_task"] = with_views(
    {
        **EXTRACTED,
        **WIDE_RULES,
        "own": f"""select e.response_id, e.success, e.content, coalesce(w.sig, {SIGNATURE}) as sig, """
        + ", ".join(f"coalesce(w.w_{r}, {DEFAULT_WEIGHTS[r]}) as w_{r}" for r in DEFAULT_RULES)
        + " from extracted e left join wide w on w.task_id = 'task_' || cast(e.response_id as varchar)",
        "featured": f"select *, {features('sig')} from own",
        "scored": "select response_id, cast(case when success then "
        + raw_score({r: f"w_{r}" for r in DEFAULT_RULES})
        + " else 0 end as int) as raw_score from featured",
    },
    "select response_id, raw_score, greatest(0, least(10, raw_score)) as compliance_score from scored",
)
_FILES = {"files": corpus.TASK_FILES_SQL}
ORACLES["task_structure_gaps"] = with_views(
    {
        **_FILES,
        "tasks": "select distinct task from files",
        "missing": """select t.task, r.ord, r.file from tasks t
          cross join (values (1, 'template.py'), (2, 'reference.py'), (3, 'tests'), (4, 'spec.json')) as r(ord, file)
          anti join files f on f.task = t.task and f.file = r.file""",
    },
    """select t.task, coalesce(string_agg(m.file, '|' order by m.ord), '') as missing_files, count(m.file) = 0 as is_valid
    from tasks t left join missing m on m.task = t.task group by t.task""",
)
ORACLES["task_catalog"] = with_views(_FILES, "select distinct task from files where file = 'spec.json'")
ORACLES["file_fingerprints"] = """select cast(doc_id // 100 as int) as bucket,
  sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as sha256 from documents group by 1"""
ORACLES["model_registry"] = with_views(
    RESPONSES,
    """select m.ordinal, m.name, count(r.response_id) as responses
    from (values (0, 'qwen2.5-coder'), (1, 'llama3'), (2, 'mistral')) as m(ordinal, name) left join responses r on r.model = m.name group by 1, 2""",
)
ORACLES["content_fingerprint"] = "select doc_id, sha256(text) as sha256 from documents"

# ---------------------------------------------------------------------------
# Attempts and runs
# ---------------------------------------------------------------------------

ATTEMPTS = {"attempts": corpus.ATTEMPTS_SQL}
WRITTEN = {
    **ATTEMPTS,
    **extraction("attempts"),
    "written": "select *, case when success then content end as new_content from extracted",
    "carried": f"""select *,
      last_value(new_content ignore nulls) over (partition by run_id order by iteration
        rows between unbounded preceding and 1 preceding) as old_content from written""",
    "patched": f"select *, coalesce(old_content, {TEMPLATE}) as before from carried",
}
ORACLES["carry_forward_content"] = with_views(
    WRITTEN, "select run_id, iteration, before as content_before from patched"
)
ORACLES["patch_size"] = with_views(
    WRITTEN,
    """select run_id, iteration, new_content is not null as patch_applied,
    case when new_content is null then 'Parsed output content is empty' end as patch_error,
    cast(case when new_content is null then 0 else abs(length(new_content) - length(before)) end as int) as bytes_changed,
    sha256(before) as original_hash, coalesce(sha256(new_content), '') as modified_hash from patched""",
)
# Known line diffs. An answer shares its function line with the template, and its last line with other answers; what
# stands before and between them is replaced as a whole, an import line first.
_DIFFS = {
    **WRITTEN,
    "blocks": """select run_id, iteration, new_content is not null and new_content <> before as changed, old_content is null as fresh,
      len(string_split(new_content, chr(10))) as n_new, len(string_split(old_content, chr(10))) as n_old,
      coalesce(starts_with(new_content, 'import '), false)::int as top_new, coalesce(starts_with(old_content, 'import '), false)::int as top_old
      from patched""",
    "diffs": """select run_id, iteration, case when not changed then 0 when fresh then n_new - 1 else n_new - 2 end as added,
      case when not changed then 0 when fresh then 2 else n_old - 2 end as deleted,
      case when not changed then 0 when fresh then top_new + greatest(n_new - 1 - top_new, 2)
        else greatest(top_new, top_old) + greatest(n_new - 2 - top_new, n_old - 2 - top_old) end as touched,
      case when not changed then 0 when fresh then 4 else 5 end as around from blocks""",
}
ORACLES["lines_changed"] = with_views(_DIFFS, "select run_id, iteration, cast(touched as int) as lines_changed from diffs")
ORACLES["diff_summary"] = with_views(
    _DIFFS,
    """select run_id, iteration, cast(added as int) as lines_added, cast(deleted as int) as lines_deleted,
    cast(added + deleted as int) as lines_touched, cast(added + deleted + around as int) as diff_lines from diffs""",
)

def _of_code(code: str, *values: str) -> str:
    """What a verdict code stands for: crash, timeout, failed tests, passed, no tests."""
    return f"case coalesce({code}, 4) " + " ".join(f"when {k} then {text(v)}" for k, v in enumerate(values)) + " end"


_CODE = "min(case outcome when 'crash' then 0 when 'timeout' then 1 when 'passed' then 3 else 2 end)"
_ERRORS = ("runtime_crash", "timeout", "verification_failed")
_MESSAGES = ("Failed to execute pytest", "Pytest execution timed out", "One or more pytest tests failed", "", "Test directory not found")
# What code parses and imports is read off its text: `x = = ` doesn't parse, and only missing packages are imported.
JUDGED = {
    **WIDE_RULES,
    "tasks": """select json_extract_string(o, '$.task_id') as task_id, json_extract_string(o, '$.name') as task_name,
      coalesce(try_cast(json_extract_string(o, '$.execution_config.max_iterations') as int), 3) as task_limit
      from objects where problems = ''""",
    "all_attempts": corpus.ATTEMPTS_SQL,
    "attempts": f"""select a.*, t.task_name, coalesce(w.sig, {SIGNATURE}) as sig, """
    + ", ".join(f"coalesce(w.w_{r}, {DEFAULT_WEIGHTS[r]}) as w_{r}" for r in DEFAULT_RULES)
    + """ from all_attempts a left join tasks t on t.task_id = a.task_id left join wide w on w.task_id = a.task_id
      where a.iteration <= coalesce(t.task_limit, 3)""",
    **{k: v for k, v in WRITTEN.items() if k != "attempts"},
    "outcomes": corpus.ATTEMPT_TESTS_SQL,
    "folded": f"""select run_id, iteration, count(*) filter (subject = 'modified') as tests, {_CODE} filter (subject = 'modified') as modified,
      {_CODE} filter (subject = 'reference') as reference, {_CODE} filter (subject = 'rerun') as rerun from outcomes group by run_id, iteration""",
    "audited": r"""select *, not contains(current, '    x = = ') as p1, regexp_extract(current, '^import (pkg_[0-9]+)', 1) as missing,
      len(regexp_split_to_array(regexp_replace(current, '\n$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) as n_lines
      from (select *, coalesce(new_content, before) as current from patched) c""",
    "staged": """select a.*, coalesce(f.tests, 0) as tests, f.modified, f.reference, f.rerun, p1 and missing = '' as p2,
      p1 and missing = '' and coalesce(f.modified, 4) = 3 as p3
      from audited a left join folded f on f.run_id = a.run_id and f.iteration = a.iteration""",
    "ran": """select * from (select *, coalesce(bool_or(p3) over (partition by run_id order by iteration
      rows between unbounded preceding and 1 preceding), false) as earlier from staged) s where not earlier""",
    "compliance": f"select *, cast(greatest(0, least(10, {raw_score({r: f'w_{r}' for r in DEFAULT_RULES})})) as int) as compliance_score "
    f"from (select *, {features('sig')} from (select * exclude (content, success), current as content from ran) r) f",
    "executed": f"""select *, iteration = max(iteration) over (partition by run_id) as is_final, p3 as success,
      case when not p1 then 'syntax' when not p2 then 'syntax|imports' else 'syntax|imports|tests' end as stage_names,
      case when not p1 then 'syntax_error' when not p2 then 'import_error' when not p3 then {_of_code('modified', *_ERRORS, '', _ERRORS[2])} end as error_type,
      case when not p1 then 'Line 2: invalid syntax' when not p2 then 'Missing module: ' || missing when not p3 then {_of_code('modified', *_MESSAGES)} else '' end
        as error_message,
      p3 and coalesce(reference, 4) = 3 and coalesce(rerun, modified) <> 3 as regression_detected,
      case when p3 and coalesce(reference, 4) = 3 and coalesce(rerun, modified) <> 3
        then 'Reference solution passes tests but modified solution fails. Modified error: ' || {_of_code('coalesce(rerun, modified)', *_MESSAGES)}
        else '' end as regression_details,
      round(sum(duration_seconds) over (partition by run_id order by iteration rows unbounded preceding), 6) as runtime_seconds,
      cast(case when new_content is null then 0 else abs(length(new_content) - length(before)) end as int) as bytes_changed,
      cast(length(coalesce(output, '')) as int) as model_output_length from compliance""",
    "finals": "select * from executed where is_final",
}
ORACLES["validation_report"] = with_views(
    JUDGED,
    """select run_id, iteration, success as overall_passed, success as verification_passed, stage_names as stages, error_type, error_message
    from executed""",
)
ORACLES["error_type_mix"] = with_views(
    JUDGED, "select model, error_type, count(*) as attempts from executed where error_type is not null group by model, error_type"
)
ORACLES["final_attempt"] = with_views(JUDGED, "select run_id, iteration, success, error_type from finals")
ORACLES["iterations_required"] = with_views(
    JUDGED, "select run_id, iteration as iterations_required, success as task_success from finals"
)
ORACLES["run_duration"] = with_views(
    JUDGED, "select run_id, count(*) as attempts, round(sum(duration_seconds), 6) as runtime_seconds from executed group by run_id"
)
ORACLES["regression_join"] = with_views(
    JUDGED, "select run_id, iteration, success, regression_detected, regression_details from finals"
)
ORACLES["attempt_explode"] = with_views(
    JUDGED,
    """select cast(run_id as varchar) as run_id, task_id, model, iteration, success, s.stage_ord, s.stage, n_stages > s.stage_ord or success as passed,
    case when n_stages = s.stage_ord then error_type end as error_type, case when n_stages = s.stage_ord then error_message else '' end as error_message
    from (select *, cast(len(string_split(stage_names, '|')) as int) as n_stages from executed) e
    cross join (values (1, 'syntax'), (2, 'imports'), (3, 'tests')) as s(stage_ord, stage) where s.stage_ord <= n_stages""",
)
_SHOWN_STAGE = "concat_ws(',', '{0}', e.{1}::varchar, case when e.{1} then '-' else e.error_type end, case when e.{1} then '' else e.error_message end, {2})"
_SHOWN_STAGES = "concat_ws('|', " + ", ".join(
    f"case when {reached} then {_SHOWN_STAGE.format(stage, passed, details)} end"
    for stage, reached, passed, details in (
        ("syntax", "true", "p1", "case when e.p1 then 'lines_of_code=' || e.n_lines else 'line_number=2' end"),
        ("imports", "e.p1", "p2", "case when e.p2 then '' else 'missing_module=' || e.missing end"),
        ("tests", "e.p2", "p3", "'tests=' || e.tests"),
    )
) + ")"
_SCORED = (
    "success as task_success", "success as verification_passed", "regression_detected", "compliance_score", "iteration as iterations_required",
    "bytes_changed", "runtime_seconds", "cast(model_output_length // 4 as int) as tokens_used", "model", "task_id", "timestamp",
    "model_output_length", "error_type",
)
ORACLES["run_results_roundtrip"] = with_views(
    JUDGED,
    f"""select cast(e.run_id as varchar) as run_id, f.timestamp, e.task_id, e.task_name, e.model as model_name, e.iteration,
    e.timestamp as attempt_timestamp, sha256(coalesce(e.output, '')) as output_sha256, e.duration_seconds, e.success, e.success as overall_passed,
    {_SHOWN_STAGES} as stages, e.regression_detected, e.regression_details,
    sha256(e.before) as original_template_hash, sha256(e.current) as modified_template_hash, """
    + ", ".join(f"f.{c.split(' as ')[0]} as scored_{c.split(' as ')[-1]}" if "cast" not in c else f"cast(f.{c[5:]}".replace(" as tokens", " as scored_tokens") for c in _SCORED)
    + f""", cast(e.run_id as varchar) as artifact_run_id, sha256({TEMPLATE}) as artifact_original_template_hash,
    sha256(f.current) as artifact_modified_template_hash, sha256({TEMPLATE}) as artifact_reference_solution_hash,
    'kind=report/run_id=' || cast(e.run_id as varchar) as artifact_validation_report_path, '' as runtime_logs, cast(null as varchar) as notes
    from (select * from executed) e join finals f on f.run_id = e.run_id""",
)
ORACLES["run_reports_roundtrip"] = with_views(
    JUDGED,
    """select cast(run_id as varchar) as run_id, success as overall_passed, cast(len(string_split(stage_names, '|')) as int) as stages,
    regression_details, sha256(current) as modified_template_hash from finals""",
)
ORACLES["run_results_rejects"] = with_views(
    {"lines": f"select {', '.join(corpus.RUN_LINES)} from documents"},
    """select case when status = 'good' then json_extract_string(doc, '$.run_id') end as run_id, case when status <> 'good' then value end as line, status
    from (select value, doc, case when doc is null or coalesce(json_type(doc, '$.execution_attempts'), 'ARRAY') <> 'ARRAY' then 'malformed'
      when json_extract_string(doc, '$.run_id') is null then 'no run_id' else 'good' end as status
      from (select value, case when json_valid(value) then value end as doc from lines) l) q""",
)
OUTCOMES = {
    "test_outcomes": corpus.TEST_OUTCOMES_SQL,
    "verdicts": """select response_id, subject, count(*) as tests, bool_and(outcome = 'passed') as passed,
      case when bool_or(outcome = 'crash') then 'runtime_crash' when bool_or(outcome = 'timeout') then 'timeout'
           when bool_or(outcome <> 'passed') then 'verification_failed' end as error_type,
      case when bool_or(outcome = 'crash') then 'Failed to execute pytest'
           when bool_or(outcome = 'timeout') then 'Pytest execution timed out'
           when bool_or(outcome <> 'passed') then 'One or more pytest tests failed' else '' end as error_message
      from test_outcomes group by response_id, subject""",
    "regressions": """select m.response_id, r.passed as reference_passed, m.passed as modified_passed,
      r.passed and not m.passed as regression_detected,
      case when r.passed and not m.passed then 'Reference solution passes tests but modified solution fails. Modified error: '
        || m.error_message else '' end as regression_details
      from verdicts m join verdicts r on r.response_id = m.response_id and r.subject = 'reference'
      where m.subject = 'modified'""",
}
ORACLES["test_verdict"] = with_views(
    OUTCOMES,
    """select response_id, subject, tests, passed, error_type, error_message from verdicts
    union all select doc_id, 'modified', 0, false, 'verification_failed', 'Test directory not found' from documents
    where doc_id not in (select response_id from verdicts where subject = 'modified')""",
)
ORACLES["response_regressions"] = with_views(OUTCOMES, "select * from regressions")
_FINAL = "select run_id, task_id, model, " + ", ".join(c for c in _SCORED if c not in ("model", "task_id", "timestamp")) + " from finals"
ORACLES["run_scores"] = with_views(
    {**JUDGED, "finals_of": _FINAL, "line_diffs": with_views(_DIFFS, "select * from diffs")},
    "select s.*, cast(d.touched as int) as lines_changed from finals_of s join line_diffs d on d.run_id = s.run_id and d.iteration = s.iterations_required",
)
ORACLES["leaderboard"] = with_views(
    {**JUDGED, "scores": _FINAL},
    """select task_id, model, count(*) as runs, round(avg(task_success::int), 6) as success_rate,
    round(avg(verification_passed::int), 6) as verification_rate, round(avg(regression_detected::int), 6) as regression_rate,
    round(avg(compliance_score), 6) as mean_compliance, round(avg(iterations_required), 6) as mean_iterations,
    round(avg(runtime_seconds), 6) as mean_runtime, cast(sum(bytes_changed) as bigint) as bytes_changed,
    cast(sum(tokens_used) as bigint) as tokens_used from scores group by task_id, model""",
)
_PROMPT_TEXTS = (
    text("You are an expert Python developer. Your task is to refactor and fix code.\n\nTASK: "),
    text("\nOBJECTIVE: "),
    text(
        "\n\nCONSTRAINTS:\n  - No classes\n  - Keep the signature\n\nRULES:\n"
        "  - Sort active users\n\nCURRENT CODE:\n```python\n"
    ),
    text("\n```\n\nEXPECTED BEHAVIOR:\n"),
    text("\n\n"),
    text(
        "\n\nOUTPUT INSTRUCTIONS:\n1. Return ONLY the complete, corrected Python code.\n"
        "2. Wrap your code in ```python``` markers.\n"
        "3. Do NOT include any explanation or comments outside the code block.\n"
        "4. Ensure the code is syntactically correct and passes all requirements.\n"
    ),
)
_REFERENCE_BLOCK = """case when iteration > 1 and t.reference_text is not null then
    'REFERENCE SOLUTION (for iteration ' || cast(iteration as varchar) || '):' || chr(10)
      || '```python' || chr(10) || t.reference_text || chr(10) || '```' || chr(10) else '' end"""
_PROMPT = " || ".join(
    part
    for fixed, value in zip(_PROMPT_TEXTS, ("t.name", "t.objective", "before", "t.expected_behavior", _REFERENCE_BLOCK, "''"))
    for part in (fixed, value)
)
ORACLES["prompt_assembly"] = with_views(
    {**JUDGED, "prompt_tasks": corpus.PROMPT_TASKS_SQL},
    f"""select run_id, iteration, case when t.task_id is not null then {_PROMPT} end as prompt,
    case when t.task_id is null then 'no_task' else 'ok' end as status
    from executed p left join prompt_tasks t on t.task_id = p.task_id""",
)
ORACLES["recent_runs"] = """select run_id from (select distinct conv_id as run_id from conversations where role = 'assistant') r
  order by cast(run_id as varchar) desc limit 10"""

# ---------------------------------------------------------------------------
# Program audits: the validity of each program shape is known; its length follows from the text.
# ---------------------------------------------------------------------------

_PROGRAMS = {
    "programs": corpus.PROGRAMS_SQL,
    "sized": r"""select *, cast(len(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) as int) as n_lines
      from programs""",
}
ORACLES["syntax_audit"] = with_views(
    _PROGRAMS,
    """select response_id, variant in (0, 1, 2, 7) as syntax_passed,
    case when variant = 5 then 'patch_application_failed' when variant in (3, 4, 6) then 'syntax_error' end as error_type,
    case variant when 3 then 'Line 1: ''('' was never closed' when 4 then 'Line 2: Indentation error'
      when 5 then 'File not found' when 6 then 'Line 1: invalid syntax' else '' end as error_message,
    case variant when 3 then 1 when 4 then 2 when 6 then 1 end as line_number,
    case when variant in (0, 1, 2, 7) then n_lines end as lines_of_code from sized""",
)
ORACLES["import_audit"] = with_views(
    _PROGRAMS,
    """select response_id, case variant when 0 then '' when 1 then 'numpy|os|json' when 2 then 'collections|pandas' else '.|torch' end
      as import_roots,
    case variant when 0 then '' when 1 then 'numpy' when 2 then 'pandas' else '.|torch' end as missing_modules,
    variant = 0 as imports_passed,
    case variant when 0 then '' when 1 then 'Missing module: numpy' when 2 then 'Missing module: pandas'
      else 'Missing module: .' end as error_message from programs where variant in (0, 1, 2, 7)""",
)

# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------

USERS = {
    "users": corpus.USERS_SQL,
    "records": "select * from users where is_record",
    "firsts": "select * from (select *, row_number() over (partition by tenant, id order by pos) as rn from records) r where rn = 1",
    "clean": "select *, coalesce(active, false) as is_active from firsts where has_name and has_active",
    "totals": """select tenant, count(*) as total_users, count(*) filter (is_active) as active_users,
      count(*) filter (not is_active) as inactive_users from clean group by tenant""",
}


def report_views(clean: str, totals: str) -> dict[str, str]:
    return {
        "lines": f"""select tenant, 0 as section, '' as name, h.k as pos, h.line from {totals}
            cross join lateral (values (0, 'USER REPORT'), (1, '==========='), (2, 'Total users: ' || cast(total_users as varchar)),
              (3, 'Active users: ' || cast(active_users as varchar)), (4, 'Inactive users: ' || cast(inactive_users as varchar)),
              (5, ''), (6, 'ACTIVE USERS:')) as h(k, line)
          union all select tenant, 2, '', h.k, h.line from {totals}
            cross join (values (0, ''), (1, 'INACTIVE USERS:')) as h(k, line)
          union all select tenant, case when is_active then 1 else 3 end, case when is_active then name else '' end, pos,
            '- ' || name || ' (id: ' || coalesce(cast(id as varchar), 'N/A') || ')' from {clean}""",
        "numbered": "select *, row_number() over (partition by tenant order by section, name, pos) as line_no from lines",
        "rendered": """select tenant, cast((line_no - 1) // 10000 as int) as part,
          string_agg(line, chr(10) order by line_no) as report from numbered group by 1, 2""",
    }


_REPORT = {**USERS, **report_views("clean", "totals")}
ORACLES["report_valid_records"] = with_views(USERS, "select tenant, pos, id, name, active from records")
ORACLES["report_dedup_first"] = with_views(USERS, "select tenant, id, pos, name, active from firsts")
ORACLES["report_required_fields"] = with_views(USERS, "select tenant, id, pos, name, active from clean")
ORACLES["report_counts"] = with_views(USERS, "select * from totals")
ORACLES["report_listing"] = with_views(
    USERS,
    """select tenant, is_active, row_number() over (partition by tenant, is_active
    order by case when is_active then name end, pos) as position, pos, name from clean""",
)
ORACLES["report_lines"] = with_views(_REPORT, "select tenant, line_no, line from numbered")
ORACLES["report_render"] = with_views(_REPORT, "select tenant, part, report from rendered")
_RAW = {
    "raw": f"select *, {corpus.RAW_USER_SHAPE} as shape, c_custkey - c_custkey % 50 as k from customer",
    "typed": """select c_nationkey as tenant, c_custkey as pos,
      case shape when 0 then 'n' || k when 1 then 'n' || k when 2 then 's' || k when 4 then 'n' || k when 8 then 'n' || k end as same,
      case shape when 1 then k || '.0' when 5 then 'N/A' when 6 then 'None' else cast(k as varchar) end as id,
      case shape when 8 then 'None' else c_name end as name, shape in (0, 2, 5) as is_active, shape <> 4 as complete
      from raw where shape not in (3, 7)""",
    "clean": """select * from (select *, row_number() over (partition by tenant, same order by pos) as rn from typed) t
      where rn = 1 and complete""",
    "totals": USERS["totals"],
    **report_views("clean", "totals"),
}
ORACLES["report_from_json"] = with_views(_RAW, "select tenant, part, report from rendered")
ORACLES["report_degenerate"] = with_views(
    {
        **USERS,
        "inputs": corpus.TENANT_INPUTS_SQL,
        "mine": "select c.* from clean c join inputs i on i.tenant = c.tenant and i.kind = 'list'",
        "all_totals": """select i.tenant, coalesce(total_users, 0) as total_users, coalesce(active_users, 0) as active_users,
          coalesce(inactive_users, 0) as inactive_users from inputs i left join totals t on t.tenant = i.tenant
          where i.kind = 'list'""",
        **report_views("mine", "all_totals"),
    },
    """select tenant, part, report from rendered union all
    select tenant, 0, case kind when 'null' then 'No users provided' else 'Invalid input type' end
    from inputs where kind <> 'list'""",
)

# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------

ORACLES["response_scoring"] = with_views(
    {
        **FEATURED,
        **{k: v for k, v in MODED.items() if k != "responses"},
        **{k: v for k, v in QUICK.items() if k != "responses"},
    },
    """select q.response_id, q.model, q.run, e.format, q.score, q.is_compliant,
    greatest(0, least(10, s.raw_score)) as compliance_score, array_to_string(m.modes, '|') as failure_modes
    from quick q join extracted e on e.response_id = q.response_id join scored s on s.response_id = q.response_id
    join moded m on m.response_id = q.response_id where q.error is null""",
)
ORACLES["stream_scoring"] = ORACLES["response_scoring"]
ORACLES["job_latest_status"] = with_views(
    {"job_events": corpus.JOB_EVENTS_SQL},
    """select job_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at, transitions from (select *,
    row_number() over (partition by job_id order by ts desc, event_id desc) as rn,
    count(*) over (partition by job_id) as transitions from job_events) e where rn = 1""",
)
ORACLES["stream_job_status"] = ORACLES["job_latest_status"]

ORACLES["batch_summary_roundtrip"] = ORACLES["batch_summary"]

# The validity of each program shape is known; its tests are those of the labels.
ORACLES["validation_pipeline"] = with_views(
    {
        "programs": corpus.PROGRAMS_SQL,
        **OUTCOMES,
        "audited": """select p.response_id as run_id, variant in (0, 1, 2, 7) as syntax, variant = 0 as imports,
          coalesce(v.passed, false) as tests,
          case when v.response_id is null then 'verification_failed' else v.error_type end as test_error,
          case when v.response_id is null then 'Test directory not found' else v.error_message end as test_message, variant
          from programs p left join (select * from verdicts where subject = 'modified') v on v.response_id = p.response_id""",
    },
    """select run_id, syntax and imports and tests as overall_passed, syntax and imports and tests as verification_passed,
    case when not syntax then 'syntax' when not imports then 'syntax|imports' else 'syntax|imports|tests' end as stages,
    case when variant = 5 then 'patch_application_failed' when not syntax then 'syntax_error'
      when not imports then 'import_error' when not tests then test_error end as error_type,
    case variant when 3 then 'Line 1: ''('' was never closed' when 4 then 'Line 2: Indentation error' when 5 then 'File not found'
      when 6 then 'Line 1: invalid syntax' when 1 then 'Missing module: numpy' when 2 then 'Missing module: pandas'
      when 7 then 'Missing module: .' else case when tests then '' else test_message end end as error_message from audited""",
)
