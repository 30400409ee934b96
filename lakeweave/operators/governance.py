"""Access decisions, row filters, column masks and privacy requests
(G1-G5, G13-G18, G20, J6).

Policies are small, hand-written rule sets. Two evaluation paths share one
semantics:

* ``decide`` evaluates one (principal, resource, access) at plan time, like a
  policy engine does before the query runs; ``secure_select`` uses it to
  rewrite a DataFrame (filter, then masked projection) so that Catalyst can
  still push the row filter into the scan.
* ``evaluate_access`` evaluates many requests as a distributed job: the rule
  set is aggregated into ONE array row and cross-joined (a one-row
  broadcast), then matched per request with higher-order functions; the
  request side is never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.columns import EMAIL_RE
from lakeweave.session import materialize

# ---------------------------------------------------------------------------
# Policy data (fixed values: the lake's access, row-filter and mask policies)
# ---------------------------------------------------------------------------

ADMIN_ACCESSES = ("select", "insert", "update", "delete", "use", "create", "drop", "alter", "index", "lock",
                  "all", "read", "write", "repladmin", "serviceadmin")
ENGINEER_ACCESSES = ("select", "insert", "update", "delete", "use", "create", "drop", "alter")

# kind, group, catalog, schema, table, accesses, schema_not_in (deny condition)
ACCESS_RULES = [
    ("allow", "platform-admins", "lakehouse", "*", "*", ADMIN_ACCESSES, None),
    ("allow", "data-engineers", "lakehouse", "*", "*", ENGINEER_ACCESSES, None),
    ("allow", "data-stewards", "lakehouse", "*", "*", ("select", "use"), None),
    ("deny", "data-analysts", "lakehouse", "*", "*", ("select",), ("lakehouse/curated",)),
    ("allow", "data-analysts", "lakehouse", "curated", "*", ("select", "use"), None),
]

# table -> ordered items (groups, filter expression). Empty expression: all rows.
ROW_FILTERS = {
    "lakehouse.curated.customers": [
        (("data-analysts",), "region = current_setting('ranger.assigned_region', true)"),
        (("data-engineers", "platform-admins"), ""),
        (("data-stewards",), ""),
    ],
}

# table -> column -> ordered items (groups, mask type, value expression)
COLUMN_MASKS = {
    "lakehouse.curated.customers": {
        "email": [(("data-analysts",), "MASK_HASH", None), (("data-stewards",), "MASK_SHOW_FIRST_4", None),
                  (("data-engineers",), "NONE", None)],
        "phone": [(("data-analysts",), "MASK_NULL", None), (("data-stewards",), "MASK_SHOW_FIRST_4", None),
                  (("data-engineers",), "NONE", None)],
        "ssn": [(("data-analysts", "data-stewards", "data-engineers"), "MASK_NULL", None),
                (("platform-admins",), "NONE", None)],
    },
}

MASK_TYPES = ("MASK", "MASK_SHOW_LAST_4", "MASK_SHOW_FIRST_4", "MASK_HASH", "MASK_NULL", "MASK_NONE",
              "MASK_DATE_SHOW_YEAR", "CUSTOM", "NONE")


@dataclass(frozen=True)
class Principal:
    user: str
    groups: tuple[str, ...]
    attributes: Mapping[str, str] = field(default_factory=dict)
    tenant_id: str | None = None


# ---------------------------------------------------------------------------
# Plan-time decisions
# ---------------------------------------------------------------------------

def _glob(pattern: str, value: str) -> bool:
    """``*`` stands for any run of characters; all else is literal, as in :func:`evaluate_access`."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), value, re.DOTALL) is not None


def decide(principal: Principal, catalog: str, schema: str, table: str, access: str,
           rules: Sequence[tuple] = ACCESS_RULES) -> str:
    """DENY if any deny rule matches, else ALLOW if an allow rule
    matches, else DENY (default deny)."""
    allow = deny = False
    for kind, group, cat, sch, tbl, accesses, not_in in rules:
        if group not in principal.groups or access not in accesses:
            continue
        if not (_glob(cat, catalog) and _glob(sch, schema) and _glob(tbl, table)):
            continue
        if kind == "deny":
            if not_in is None or f"{catalog}/{schema}" not in not_in:
                deny = True
        else:
            allow = True
    return "DENY" if deny else ("ALLOW" if allow else "DENY")


def _bind_attributes(expr: str, principal: Principal) -> str:
    """Session attributes as literals. A value is written in hexadecimal, so no
    character of it (quote, backslash) is ever read as SQL."""
    def repl(m: re.Match) -> str:
        v = principal.attributes.get(m.group(1))
        return "CAST(NULL AS STRING)" if v is None else f"decode(X'{v.encode('utf-8').hex()}', 'UTF-8')"
    return re.sub(r"current_setting\('([^']+)'(?:\s*,\s*true)?\)", repl, expr)


def row_filter_condition(table: str, principal: Principal,
                         filters: Mapping[str, list] = ROW_FILTERS) -> Column | None:
    """The first item matching one of the principal's groups wins; an
    empty expression passes every row; a table with filter items but no
    matching item yields no rows. None: the table has no row filter."""
    items = filters.get(table)
    if items is None:
        return None
    for groups, expr in items:
        if set(groups) & set(principal.groups):
            return F.lit(True) if not expr.strip() else F.expr(_bind_attributes(expr, principal))
    return F.lit(False)


def row_filter(df: DataFrame, table: str, principal: Principal,
               filters: Mapping[str, list] = ROW_FILTERS) -> DataFrame:
    cond = row_filter_condition(table, principal, filters)
    return df if cond is None else df.filter(cond)


def tenant_filter(df: DataFrame, principal: Principal, tenant_col: str = "tenant_id",
                  admin_groups: Sequence[str] = ("platform-admins",)) -> DataFrame:
    """Rows of the principal's tenant only, unless the principal is an admin."""
    if set(admin_groups) & set(principal.groups):
        return df
    return df.filter(F.col(tenant_col) == F.lit(principal.tenant_id))


def mask_expr(c: Column, mask_type: str, dtype: T.DataType, value_expr: str | None = None,
              name: str | None = None) -> Column:
    """G1: the Column that implements one mask type."""
    s = c.cast("string")
    if mask_type in ("NONE", "MASK_NONE"):
        return c
    if mask_type == "MASK_HASH":
        return F.sha2(s, 256)
    if mask_type == "MASK_NULL":
        return F.lit(None).cast(dtype)
    if mask_type == "MASK_SHOW_FIRST_4":
        return F.concat(F.substring(s, 1, 4), F.repeat(F.lit("x"), F.greatest(F.length(s) - 4, F.lit(0))))
    if mask_type == "MASK_SHOW_LAST_4":
        return F.concat(F.repeat(F.lit("x"), F.greatest(F.length(s) - 4, F.lit(0))),
                        F.when(F.length(s) > 4, F.substring(s, -4, 4)).otherwise(s))
    if mask_type == "MASK":
        return F.mask(s, F.lit("X"), F.lit("x"), F.lit("n"))
    if mask_type == "MASK_DATE_SHOW_YEAR":
        return F.make_date(F.year(c), F.lit(1), F.lit(1)).cast(dtype)
    if mask_type == "CUSTOM":
        if not value_expr:
            raise ValueError("CUSTOM mask needs a value expression")
        return F.expr(value_expr.replace("{col}", f"`{name}`"))
    raise ValueError(f"unknown mask type {mask_type!r}")


def column_masks_for(table: str, principal: Principal, masks: Mapping[str, Mapping] = COLUMN_MASKS) -> dict:
    """Mask decision per column: the first item with a matching group wins
    (items are ordered; decision of the library). No item: unmasked."""
    out = {}
    for column, items in masks.get(table, {}).items():
        for groups, mtype, vexpr in items:
            if set(groups) & set(principal.groups):
                out[column] = (mtype, vexpr)
                break
    return out


def mask_columns(df: DataFrame, table: str, principal: Principal,
                 masks: Mapping[str, Mapping] = COLUMN_MASKS) -> DataFrame:
    """G1: masked projection; never changes the row count."""
    decisions = column_masks_for(table, principal, masks)
    cols = []
    for f in df.schema.fields:
        if f.name in decisions:
            mtype, vexpr = decisions[f.name]
            cols.append(mask_expr(F.col(f.name), mtype, f.dataType, vexpr, f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class AccessDenied(PermissionError):
    pass


def secure_select(df: DataFrame, table: str, principal: Principal, access: str = "select",
                  rules: Sequence[tuple] = ACCESS_RULES, filters: Mapping[str, list] = ROW_FILTERS,
                  masks: Mapping[str, Mapping] = COLUMN_MASKS) -> DataFrame:
    """Access decision, then row filter, then column masks."""
    catalog, schema, name = table.split(".")
    if decide(principal, catalog, schema, name, access, rules) != "ALLOW":
        raise AccessDenied(f"{principal.user} may not {access} {table}")
    return mask_columns(row_filter(df, table, principal, filters), table, principal, masks)


# ---------------------------------------------------------------------------
# Distributed access evaluation (J6 / G4 over many requests)
# ---------------------------------------------------------------------------

def rules_frame(spark: SparkSession, rules: Sequence[tuple] = ACCESS_RULES) -> DataFrame:
    rows = [(i, k, g, c, s, t, list(a), list(n) if n else None) for i, (k, g, c, s, t, a, n) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, kind string, grp string, catalog string, schema string, "
                                       "tbl string, accesses array<string>, schema_not_in array<string>")


#: How a pattern's component is looked up: any value, one value, or (from 0 up) a prefix of that length.
ANY, EXACT = -1, -2
_COMPONENTS = (("catalog", "catalog"), ("schema", "schema"), ("tbl", "table"))


def _shape(pattern: Column) -> Column:
    star = F.locate("*", pattern)
    return F.when(pattern == "*", ANY).when(star == 0, EXACT).otherwise(star - 1)


def _lookup(shape: Column, value: Column) -> Column:
    """The key under which a value, or a pattern's literal beginning, is found; null for a null value."""
    return F.when(shape == EXACT, value).when(shape == ANY, F.when(value.isNotNull(), "")).otherwise(value.substr(F.lit(1), shape))


def rule_index(rules: DataFrame) -> DataFrame:
    """One row per rule and access: ``grp``, ``access``, the three shapes and keys, and what a key leaves open: the literals of
    a glob after its beginning (``rest_catalog`` ...: null if the key says all), ``is_deny``, ``schema_not_in``."""
    out = rules.select("*", F.explode("accesses").alias("access"))
    for c, _ in _COMPONENTS:
        shape = _shape(F.col(c))
        out = (out.withColumn(f"shape_{c}", shape).withColumn(f"key_{c}", _lookup(shape, F.col(c)))
                  .withColumn(f"rest_{c}", F.when(shape >= 0, F.split(F.col(c), r"\*"))))
    return out.select("grp", "access", *[f"{p}_{c}" for c, _ in _COMPONENTS for p in ("shape", "key", "rest")],
                      (F.col("kind") == "deny").alias("is_deny"), "schema_not_in")


def _rest_fits(rest: Column, value: Column) -> Column:
    """Whether the literals of a glob follow each other in ``value``, the first at its begin and the last at its end:
    a search from left to right, without a pattern."""
    first, last = F.element_at(rest, 1), F.element_at(rest, -1)
    middle = F.slice(rest, 2, F.greatest(F.size(rest) - 2, F.lit(0)))
    at = F.aggregate(middle, F.length(first) + 1, lambda a, x: F.when((a == 0) | (x == ""), a).otherwise(
        F.when(F.call_function("locate", x, value, a) == 0, 0).otherwise(F.call_function("locate", x, value, a) + F.length(x))))
    ends = (at > 0) & (at - 1 + F.length(last) <= F.length(value)) & F.endswith(value, last)
    return rest.isNull() | ends


def evaluate_access(requests: DataFrame, rules: DataFrame, groups_col: str = "groups") -> DataFrame:
    """J6 + G4: decision per request row (columns catalog, schema, table, access and an array of groups); deny
    beats allow, no rule denies.

    Rules are found by equality: each distinct combination of groups, resource and access asks for one key per group
    and shape of pattern that occurs among the rules (few: the shapes are the parameters of a policy set, not its
    rules), and only a glob's literals after the first star are looked at for what was found. The requests
    themselves are joined to the combinations' decisions; they are not exploded."""
    index = rule_index(rules)
    shapes = [tuple(r) for r in index.select(*[f"shape_{c}" for c, _ in _COMPONENTS]).distinct().collect()]
    keys = [groups_col, "catalog", "schema", "table", "access"]
    combos = requests.select(*keys).distinct()
    decided = combos.limit(0).select(*keys, F.lit("").alias("__d")) if not shapes else None
    if decided is None:
        shape = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for (c, _), x in zip(_COMPONENTS, s)]) for s in shapes]))
        asked = combos.select(*keys, F.explode(F.array_distinct(groups_col)).alias("__grp")).select("*", shape.alias("__s"))
        asked = asked.select(*keys, "__grp", *[F.col("__s")[c].alias(f"__shape_{c}") for c, _ in _COMPONENTS],
                             *[_lookup(F.col("__s")[c], F.col(v)).alias(f"__key_{c}") for c, v in _COMPONENTS])
        on = (F.col("__grp") == F.col("grp")) & (asked["access"] == index["access"])
        for c, _ in _COMPONENTS:
            on = on & (F.col(f"__shape_{c}") == F.col(f"shape_{c}")) & (F.col(f"__key_{c}") == F.col(f"key_{c}"))
        found = asked.join(index, on).drop(index["access"])
        for c, v in _COMPONENTS:
            found = found.filter(_rest_fits(F.col(f"rest_{c}"), F.col(v)))
        excepted = F.coalesce(F.array_contains("schema_not_in", F.concat_ws("/", "catalog", "schema")), F.lit(False))
        found = found.filter(~F.col("is_deny") | ~excepted)
        decided = found.groupBy(*keys).agg(F.when(F.max("is_deny"), "DENY").otherwise("ALLOW").alias("__d"))
    d = decided.select(*[F.col(k).alias(f"__{k}") for k in keys], "__d")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (requests.join(d, same, "left").withColumn("decision", F.coalesce("__d", F.lit("DENY")))
            .drop("__d", *[f"__{k}" for k in keys]))


# ---------------------------------------------------------------------------
# Privacy requests
# ---------------------------------------------------------------------------

def erase_subject(tables: Mapping[str, DataFrame], keys: Mapping[str, str], ids: DataFrame,
                  id_col: str = "subject_id") -> dict[str, DataFrame]:
    """Every mapped table without the subjects' rows (anti join; the id
    list goes through the normal join planning, so AQE broadcasts it only
    when it is small)."""
    subj = ids.select(F.col(id_col).alias("__sid")).distinct()
    return {name: df.join(subj, F.col(keys[name]) == F.col("__sid"), "left_anti") for name, df in tables.items()}


def erase_and_verify(tables: Mapping[str, DataFrame], keys: Mapping[str, str], ids: DataFrame,
                     id_col: str = "subject_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """G13 as carried out: the remaining rows of every table are written, and what is left of the
    subjects is counted in the written files, read back. Returns the new tables and the results."""
    after = {name: materialize(df, f"erased-{name}") for name, df in erase_subject(tables, keys, ids, id_col).items()}
    return after, erasure_results(tables, after, keys, ids, id_col)


def erasure_results(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], keys: Mapping[str, str],
                    ids: DataFrame, id_col: str = "subject_id") -> DataFrame:
    """G13 verification: per subject and table, rows removed and rows left
    (must be 0)."""
    subj = ids.select(F.col(id_col).alias("subject_id")).distinct()
    parts = []
    for name in before:
        k = keys[name]
        removed = (before[name].join(subj, F.col(k) == F.col("subject_id"))
                   .groupBy("subject_id").agg(F.count(F.lit(1)).alias("rows_removed")))
        left = (after[name].join(subj, F.col(k) == F.col("subject_id"))
                .groupBy("subject_id").agg(F.count(F.lit(1)).alias("rows_left")))
        parts.append(subj.join(removed, "subject_id", "left").join(left, "subject_id", "left")
                     .select("subject_id", F.lit(name).alias("table_name"),
                             F.coalesce("rows_removed", F.lit(0)).alias("rows_removed"),
                             F.coalesce("rows_left", F.lit(0)).alias("rows_left")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erasure_certificate(results: DataFrame, completed_at: str) -> DataFrame:
    """One certificate per subject: tables affected (sorted), rows
    erased, verified when nothing is left."""
    return results.groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rows_removed") > 0, F.col("table_name")))).alias("tables_affected"),
        F.sum("rows_removed").alias("rows_erased"),
        (F.sum("rows_left") == 0).alias("verified"),
    ).withColumn("completed_at", F.lit(completed_at).cast("timestamp_ntz")) \
     .withColumn("certificate_id", F.sha2(F.concat_ws("|", F.col("subject_id").cast("string"),
                                                      F.lit(completed_at)), 256))


def redact(df: DataFrame, col: str, patterns: Sequence[str] = (EMAIL_RE,), subjects: DataFrame | None = None,
           subject_key: str | None = None, token: str = "[REDACTED]") -> DataFrame:
    """Replace personal data in a text column by a token. With
    ``subjects`` only the subjects' rows are redacted (semi-join flag)."""
    red = F.col(col)
    for p in patterns:
        red = F.regexp_replace(red, p, token)
    if subjects is None:
        return df.withColumn(col, red)
    flag = subjects.select(F.col(subject_key).alias("__sk")).distinct().withColumn("__hit", F.lit(True))
    j = df.join(flag, F.col(subject_key) == F.col("__sk"), "left")
    return j.withColumn(col, F.when(F.col("__hit"), red).otherwise(F.col(col))).drop("__sk", "__hit")


def anonymize(df: DataFrame, ids: DataFrame, key: str, columns: Sequence[str], id_col: str = "subject_id") -> DataFrame:
    """Replace identifying columns of the given subjects by a stable
    pseudonym ``anon-<md5(key)>``; other rows unchanged."""
    flag = ids.select(F.col(id_col).alias("__sid")).distinct().withColumn("__anon", F.lit(True))
    j = df.join(flag, F.col(key) == F.col("__sid"), "left")
    pseudo = F.concat(F.lit("anon-"), F.md5(F.col(key).cast("string")))
    out = j
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__anon"), pseudo).otherwise(F.col(c)))
    return out.drop("__sid", "__anon")


def rectify(df: DataFrame, corrections: DataFrame, key: str, changed_at: str) -> tuple[DataFrame, DataFrame]:
    """Apply corrections (merge) and return the change rows kept as
    history: (key, column, old_value, new_value, changed_at)."""
    from lakeweave.operators.tables import merge_upsert
    cols = [c for c in corrections.columns if c != key]
    full = df.join(corrections.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols]), key, "inner")
    for c in cols:
        full = full.withColumn(f"__new_{c}", F.col(f"__new_{c}").cast(df.schema[c].dataType))
    changes = full.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("old_value"),
                 F.col(f"__new_{c}").cast("string").alias("new_value")) for c in cols])).alias("x")) \
        .select(key, "x.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value"))) \
        .withColumn("changed_at", F.lit(changed_at).cast("timestamp_ntz"))
    updated = full.select(key, *[F.col(f"__new_{c}").alias(c) for c in cols],
                          *[c for c in df.columns if c != key and c not in cols]).select(*df.columns)
    return merge_upsert(df, updated, [key]), changes


def subject_report(tables: Mapping[str, DataFrame], keys: Mapping[str, str], ids: DataFrame,
                   id_col: str = "subject_id") -> DataFrame:
    """Every record of the subjects across tables, as JSON documents."""
    subj = ids.select(F.col(id_col).alias("subject_id")).distinct()
    parts = []
    for name, df in tables.items():
        k = keys[name]
        rec = df.join(subj, F.col(k) == F.col("subject_id")).select(
            "subject_id", F.lit(name).alias("table_name"),
            F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
        parts.append(rec)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Tag-driven masking
# ---------------------------------------------------------------------------

# Mask per tag and group.
TAG_MASKS = {
    "PII_HIGH": {"data-analysts": "MASK_NULL", "data-stewards": "MASK_SHOW_LAST_4", "data-engineers": "NONE"},
}


#: Mask types from the one that shows least.
RESTRICTIVE = ("MASK_NULL", "MASK_HASH", "MASK", "MASK_SHOW_LAST_4", "MASK_SHOW_FIRST_4", "MASK_DATE_SHOW_YEAR",
               "CUSTOM", "MASK_NONE", "NONE")


def mask_by_tags(df: DataFrame, tags: DataFrame, group: str, tag_masks: Mapping[str, Mapping] = TAG_MASKS) -> DataFrame:
    """Mask the columns carrying a tag with the group's mask, the most
    restrictive one if a column carries several. The tag
    table is per-column metadata (bounded by the schema width)."""
    tagged: dict[str, list] = {}
    for r in tags.select("column_name", "tag").distinct().collect():
        tagged.setdefault(r["column_name"], []).append(r["tag"])
    cols = []
    for f in df.schema.fields:
        # a tag without a policy, or a group that a policy does not name, masks in full
        masks = [tag_masks.get(tag, {}).get(group, "MASK_NULL") for tag in tagged.get(f.name, [])]
        mtype = min(masks, key=RESTRICTIVE.index, default="NONE")
        cols.append(mask_expr(F.col(f.name), mtype, f.dataType).alias(f.name))
    return df.select(*cols)
