"""Reports: the documented behaviors of the report task, one tenant per case."""

import random

import pytest

from codeassay.operators import report

USERS = (
    "tenant string, pos long, id long, name string, active boolean, is_record boolean, "
    "has_name boolean, has_active boolean, has_id boolean"
)


def row(tenant, pos, item):
    if not isinstance(item, dict):
        return (tenant, pos, None, None, None, False, False, False, False)
    active = item.get("active")
    return (
        tenant,
        pos,
        item.get("id"),
        item.get("name"),
        active if isinstance(active, bool) else None,
        True,
        "name" in item,
        "active" in item,
        "id" in item,
    )


def u(i, name, active):
    return {"id": i, "name": name, "active": active}


CASES = {
    "valid": [u(1, "Alice", True), u(2, "Bob", False), u(3, "Charlie", True), u(4, "Diana", False)],
    "duplicates": [u(1, "Alice", True), u(2, "Bob", False), u(1, "Alice_Duplicate", True), u(3, "Charlie", True)],
    "invalid": [u(1, "Alice", True), {"id": 2}, "text", {"id": 3, "name": "Charlie"}, u(4, "Diana", False)],
    "unsorted": [u(3, "Charlie", True), u(1, "Alice", True), u(2, "Bob", False), u(4, "Diana", True)],
    "not_records": [u(1, "Alice", True), "x", 123, None, u(2, "Bob", False)],
    "incomplete": [u(1, "Alice", True), {"id": 2, "name": "Bob"}, {"id": 3, "active": False}, u(4, "Diana", False)],
    "incomplete_first": [{"id": 1}, u(1, "Late", True)],
    "single": [u(1, "Alice", True)],
    "all_active": [u(1, "Alice", True), u(2, "Bob", True)],
    "all_inactive": [u(1, "Alice", False), u(2, "Bob", False)],
    "special": [u(1, "Alice O'Brien", True), u(2, "Bob & Co.", False), u(3, "Charlie 中文", True)],
    "truthy": [u(1, "Yes", "active"), u(2, "One", 1), u(3, "Null", None), u(4, "True", True)],
    "no_id": [{"name": "A", "active": True}, {"name": "B", "active": True}, u(None, "C", False)],
    "null_id": [u(None, "C", False)],
    "ties": [u(5, "Same", True), u(4, "Same", True), u(3, "same", True)],
    "empty": [],
}


def expected(items):
    """Plain statement of the report: first per id, complete only, active by name."""
    first = {}
    for item in items:
        if isinstance(item, dict):
            first.setdefault(item.get("id"), item)
    kept = [i for i in first.values() if {"name", "active"} <= i.keys()]
    on = sorted((i for i in kept if i["active"] is True), key=lambda i: i["name"])
    off = [i for i in kept if i["active"] is not True]
    show = lambda i: f"- {i['name']} (id: {i.get('id', 'N/A')})"
    head = ["USER REPORT", "===========", f"Total users: {len(kept)}", f"Active users: {len(on)}", f"Inactive users: {len(off)}"]
    return "\n".join([*head, "", "ACTIVE USERS:", *map(show, on), "", "INACTIVE USERS:", *map(show, off)])


@pytest.fixture(scope="module")
def users(spark):
    rows = [row(t, pos, item) for t, items in CASES.items() for pos, item in enumerate(items)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, USERS).repartition(5)


def test_reports(spark, users):
    kinds = [(t, "list") for t in CASES] + [("absent", "null"), ("text", "string")]
    inputs = spark.createDataFrame(kinds, "tenant string, kind string")
    got = {r.tenant: r.report for r in report.reports(inputs, users).collect()}
    for tenant, items in CASES.items():
        assert got[tenant] == expected(items), tenant
    assert got["absent"] == "No users provided" and got["text"] == "Invalid input type"
    assert "Total users: 0" in got["empty"]


def test_parts_join_to_the_report(spark, users):
    lines = report.report_lines(report.cleaned(users))
    parts = {}
    for r in report.render(lines, part_lines=3).orderBy("tenant", "part").collect():
        parts.setdefault(r.tenant, []).append(r.report)
    assert len(parts["valid"]) > 1
    for tenant, texts in parts.items():
        assert "\n".join(texts) == expected(CASES[tenant])


def test_listing_and_counts(spark, users):
    clean = report.cleaned(users)
    listed = [(r.is_active, r.position, r.name) for r in report.listing(clean).filter("tenant = 'unsorted'").collect()]
    assert sorted(listed) == [(False, 1, "Bob"), (True, 1, "Alice"), (True, 2, "Charlie"), (True, 3, "Diana")]
    row = report.counts(clean).filter("tenant = 'duplicates'").first()
    assert (row.total_users, row.active_users, row.inactive_users) == (3, 2, 1)


def test_hot_null_id_and_long_tenant(spark):
    """Most rows share one tenant and the null id; the report still matches."""
    items = [u(None if i % 2 else i, f"n{i * 7919 % 5000:05d}", i % 3 != 0) for i in range(4000)]
    df = spark.createDataFrame([row("hot", pos, item) for pos, item in enumerate(items)], USERS).repartition(6)
    parts = report.render(report.report_lines(report.cleaned(df)), part_lines=500).orderBy("part").collect()
    assert "\n".join(p.report for p in parts) == expected(items)


def test_raw_items(spark):
    """Equal ids of different types, and the text each scalar shows."""
    items = {
        "equal": ['{"id": 1, "name": "int", "active": true}', '{"id": 1.0, "name": "float", "active": true}', '{"id": true, "name": "bool", "active": true}'],
        "float": ['{"id": 1.0, "name": "a", "active": true}', '{"id": "1", "name": "b", "active": true}', '{"id": 2.5, "name": "c", "active": "true"}'],
        "bool": ['{"id": true, "name": "a", "active": true}', '{"id": null, "name": null, "active": null}', '{"name": "late", "active": true}'],
        "none": ['5', 'null', '"x"', '[1]', 'not json'],
    }
    import json

    def parsed(text):
        try:
            return json.loads(text)
        except ValueError:
            return text

    raw = spark.createDataFrame([(t, i, x) for t, xs in items.items() for i, x in enumerate(xs)], "tenant string, pos long, item string")
    tenants = spark.createDataFrame([(t,) for t in items], "tenant string")
    lines = report.report_lines(report.cleaned(report.parse_users(raw)), tenants)
    got = {r.tenant: r.report for r in report.render(lines).collect()}
    for tenant, texts in items.items():
        assert got[tenant] == expected([parsed(x) for x in texts]), tenant
