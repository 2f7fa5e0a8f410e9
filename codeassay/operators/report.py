"""Deduplicated, ordered user reports, one per tenant.

``users``: tenant, pos (arrival order), id, name, active, is_record, has_name, has_active, and
optionally has_id and id_key. Without has_id, a null id means that the key is absent. ``id_key``, if
present, decides which ids are equal. ``parse_users`` makes this table from raw JSON items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeassay.functions.text import settle
from codeassay.operators.skew import number_in_groups

# A part is small enough for one task to join; a report is the join of its parts by newline.
PART_LINES = 10_000

# Fixed texts.
NO_USERS, BAD_INPUT = "No users provided", "Invalid input type"


def _shown(doc: Column, path: str) -> Column:
    """A JSON scalar as report text: True/False for booleans, None for null, 1.0 keeps its point."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    text = F.try_variant_get(doc, path, "string")
    whole_decimal = kind.rlike(r"^DECIMAL\(\d\d?,0\)$") & (F.length(text) < 19)
    return (
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "VOID", F.lit("None"))
        .when(whole_decimal, F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def _equal_key(doc: Column, path: str) -> Column:
    """Equal for equal ids: 1, 1.0 and true are one id, while "1" is another. Null for null or absent."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    text = F.try_variant_get(doc, path, "string")
    number = F.try_variant_get(doc, path, "double")
    whole = F.coalesce(number == F.try_variant_get(doc, path, "bigint").cast("double"), F.lit(False))
    return (
        F.when(kind == "STRING", F.concat(F.lit("s"), text))
        .when(kind.isin("BIGINT", "BOOLEAN") | (F.startswith(kind, F.lit("D")) & whole),
              F.concat(F.lit("n"), F.try_variant_get(doc, path, "bigint").cast("string")))
        .when(F.startswith(kind, F.lit("D")), F.concat(F.lit("n"), text))
        .when(kind != "VOID", F.concat(F.lit("j"), text))
    )


def parse_users(raw: DataFrame, item: str = "item") -> DataFrame:
    """The ``users`` table from raw items (tenant, pos, JSON text). Anything but an object is no record."""
    doc = F.col("_doc")
    parsed = settle(raw, {"_doc": F.try_parse_json(F.col(item))})

    def present(key: str) -> Column:
        return F.try_variant_get(doc, f"$.{key}", "variant").isNotNull()

    active = F.try_variant_get(doc, "$.active", "variant")
    return parsed.select(
        "tenant",
        "pos",
        _shown(doc, "$.id").alias("id"),
        _equal_key(doc, "$.id").alias("id_key"),
        _shown(doc, "$.name").alias("name"),
        F.when(F.schema_of_variant(active) == "BOOLEAN", F.try_variant_get(doc, "$.active", "boolean")).alias("active"),
        F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)).alias("is_record"),
        present("id").alias("has_id"),
        present("name").alias("has_name"),
        present("active").alias("has_active"),
    )


def valid_records(users: DataFrame) -> DataFrame:
    """Items that are records; others are skipped before deduplication."""
    return users.filter("is_record").drop("is_record")


def keep_first(records: DataFrame) -> DataFrame:
    """First record per tenant and id, null being one id, incomplete records included.

    An aggregation rather than a window: a hot id (null above all) shrinks to one row per task
    before anything is shuffled.
    """
    keys = ["tenant", "id_key" if "id_key" in records.columns else "id"]
    rest = [c for c in records.columns if c not in keys]
    return (
        records.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "pos").alias("_first"))
        .select(*keys, "_first.*")
        .select(*records.columns)
    )


def complete_records(records: DataFrame) -> DataFrame:
    """Drop records whose ``name`` or ``active`` key is absent; present nulls stay."""
    return records.filter("has_name and has_active").drop("has_name", "has_active")


def cleaned(users: DataFrame) -> DataFrame:
    """The three steps in order, plus ``is_active``: exactly true is active, all else is not."""
    return complete_records(keep_first(valid_records(users))).withColumn(
        "is_active", F.coalesce(F.col("active"), F.lit(False))
    )


def counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if("is_active").alias("active_users"),
        F.count_if(~F.col("is_active")).alias("inactive_users"),
    )


def listing(clean: DataFrame) -> DataFrame:
    """Rank within tenant and status: active by name, then arrival; inactive by arrival."""
    keyed = clean.withColumn("_key", F.when(F.col("is_active"), F.col("name")))
    return number_in_groups(keyed, ["tenant", "is_active"], ["_key", "pos"], "position").drop("_key")


def _user_line(clean: DataFrame) -> Column:
    absent = ~F.col("has_id") if "has_id" in clean.columns else F.col("id").isNull()
    shown = F.when(absent, F.lit("N/A")).otherwise(F.coalesce(F.col("id").cast("string"), F.lit("None")))
    return F.concat(F.lit("- "), F.coalesce("name", F.lit("None")), F.lit(" (id: "), shown, F.lit(")"))


def report_lines(clean: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Reports as (tenant, line_no, line) rows, for reports of any length.

    Headings are rows of the same sort as the users, so one ranking numbers every line.
    ``tenants`` adds zero-count reports for those without users.
    """
    totals = counts(clean)
    if tenants is not None:
        totals = tenants.select("tenant").join(totals, "tenant", "left").fillna(0)

    def total(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))

    headings = [
        (0, F.lit("USER REPORT")),
        (0, F.lit("===========")),
        (0, total("Total users", "total_users")),
        (0, total("Active users", "active_users")),
        (0, total("Inactive users", "inactive_users")),
        (0, F.lit("")),
        (0, F.lit("ACTIVE USERS:")),
        (2, F.lit("")),
        (2, F.lit("INACTIVE USERS:")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.lit(None).cast("string").alias("sort_name"),
                F.lit(at).cast("long").alias("pos"),
                text.alias("line"),
            )
            for at, (section, text) in enumerate(headings)
        ]
    )
    people = clean.select(
        "tenant",
        F.when(F.col("is_active"), F.lit(1)).otherwise(F.lit(3)).alias("section"),
        F.when(F.col("is_active"), F.col("name")).alias("sort_name"),
        F.col("pos").cast("long").alias("pos"),
        _user_line(clean).alias("line"),
    )
    lines = totals.select("tenant", F.inline(rows)).unionByName(people)
    return number_in_groups(lines, ["tenant"], ["section", "sort_name", "pos"], "line_no").select(
        "tenant", "line_no", "line"
    )


def render(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Report texts in parts of at most ``part_lines`` lines; part 0 is all of an ordinary report."""
    return (
        lines.withColumn("part", F.floor((F.col("line_no") - 1) / part_lines).cast("int"))
        .groupBy("tenant", "part")
        .agg(F.expr("listagg(line, '\n') within group (order by line_no)").alias("report"))
    )


def reports(inputs: DataFrame, users: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """A report for every tenant of ``inputs`` (tenant, kind: 'null' | 'list' | other).

    Null and non-list inputs have fixed one-line reports; an empty list has zero counts.
    """
    lists = inputs.filter("kind = 'list'")
    mine = cleaned(users).join(lists.select("tenant"), "tenant", "left_semi")
    fixed = inputs.filter("kind <> 'list'").select(
        "tenant",
        F.lit(0).alias("part"),
        F.when(F.col("kind") == "null", F.lit(NO_USERS)).otherwise(F.lit(BAD_INPUT)).alias("report"),
    )
    return render(report_lines(mine, lists), part_lines).unionByName(fixed)
