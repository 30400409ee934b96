"""Oracle side of ``validate``: compile a suite into DuckDB SQL (one SELECT per
rule over the table, UNION ALL). Independent of the Spark compiler; the rule
semantics are the ones documented in ``lakeweave.operators.quality``."""

from __future__ import annotations

from typing import Sequence

from lakeweave.operators.quality import PAIR, parse_bound


def _q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _lit(v) -> str:
    import datetime as dt
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
    return repr(float(v))


def _ok(e: str, u: str, mostly: float) -> str:
    return f"(({e}) = 0 OR 1.0 - CAST(({u}) AS DOUBLE) / ({e}) >= {float(mostly)!r})"


def suite_sql(table_sql: str, columns: Sequence[str], numeric: Sequence[str], suite: Sequence[dict],
              suite_name: str) -> str:
    cols = set(columns)
    parts = []

    def row(i, t, c, e="NULL", u="NULL", obs="NULL", ok="FALSE", frm="t"):
        return (f"SELECT {_q(suite_name)} AS suite, {i} AS rule_index, {_q(t)} AS expectation, "
                f"CAST({_q(c)} AS VARCHAR) AS column_name, CAST({e} AS BIGINT) AS element_count, "
                f"CAST({u} AS BIGINT) AS unexpected_count, CAST({obs} AS DOUBLE) AS observed_value, "
                f"({ok}) AS success FROM {frm}")

    for i, r in enumerate(suite):
        t, kw = r["expectation_type"], r["kwargs"]
        c = kw.get("column")
        mostly = kw.get("mostly", 1.0)
        if t == "expect_column_to_exist":
            parts.append(row(i, t, c, ok="TRUE" if c in cols else "FALSE", frm="(SELECT 1)"))
        elif t == "expect_table_columns_to_match_set":
            need = set(kw["column_set"])
            ok = (need == cols) if kw.get("exact_match") else not (need - cols)
            parts.append(row(i, t, None, u=str(len(need - cols)), ok="TRUE" if ok else "FALSE", frm="(SELECT 1)"))
        elif t == "expect_table_row_count_to_be_between":
            conds = ["TRUE"]
            if kw.get("min_value") is not None:
                conds.append(f"count(*) >= {kw['min_value']}")
            if kw.get("max_value") is not None:
                conds.append(f"count(*) <= {kw['max_value']}")
            parts.append(row(i, t, None, e="count(*)", obs="count(*)", ok=" AND ".join(conds)))
        elif t in PAIR:
            a, b = kw["column_A"], kw["column_B"]
            label = f"{a},{b}"
            if a not in cols or b not in cols:
                parts.append(row(i, t, label, frm="(SELECT 1)"))
                continue
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            good = f"{a} = {b}" if t == "expect_column_pair_values_to_be_equal" else \
                (f"{a} >= {b}" if kw.get("or_equal") else f"{a} > {b}")
            e = f"count(CASE WHEN {both} THEN 1 END)"
            u = f"count(CASE WHEN {both} AND NOT ({good}) THEN 1 END)"
            parts.append(row(i, t, label, e, u, f"CASE WHEN {e} > 0 THEN CAST({u} AS DOUBLE) / {e} END",
                             _ok(e, u, mostly)))
        elif c not in cols:
            parts.append(row(i, t, c, frm="(SELECT 1)"))
        elif t == "expect_column_values_to_not_be_null":
            e, u = "count(*)", f"(count(*) - count({c}))"
            parts.append(row(i, t, c, e, u, f"CASE WHEN {e} > 0 THEN CAST({u} AS DOUBLE) / {e} END", _ok(e, u, mostly)))
        elif t in ("expect_column_values_to_be_unique", "expect_column_proportion_of_unique_values_to_be_between"):
            frm = (f"(SELECT coalesce(sum(n), 0) AS e, count(*) AS nd, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS dup "
                   f"FROM (SELECT {c}, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}))")
            if t == "expect_column_values_to_be_unique":
                parts.append(row(i, t, c, "e", "dup", "CASE WHEN e > 0 THEN CAST(dup AS DOUBLE) / e END",
                                 _ok("e", "dup", mostly), frm))
            else:
                p = "CAST(nd AS DOUBLE) / e"
                conds = ["TRUE"]
                if kw.get("min_value") is not None:
                    conds.append(f"{p} >= {float(kw['min_value'])!r}")
                if kw.get("max_value") is not None:
                    conds.append(f"{p} <= {float(kw['max_value'])!r}")
                parts.append(row(i, t, c, "e", "NULL", f"CASE WHEN e > 0 THEN {p} END",
                                 f"e = 0 OR coalesce({' AND '.join(conds)}, FALSE)", frm))
        else:
            if t == "expect_column_values_to_match_regex":
                bad = f"NOT regexp_matches(CAST({c} AS VARCHAR), {_q(kw['regex'])})"
            elif t == "expect_column_values_to_be_in_set":
                bad = f"{c} NOT IN ({', '.join(_q(v) for v in kw['value_set'])})"
            elif t == "expect_column_values_to_be_between":
                as_dt = bool(kw.get("parse_strings_as_datetimes"))
                v = f"TRY_CAST({c} AS TIMESTAMP)" if as_dt else \
                    (f"CAST({c} AS DOUBLE)" if c in numeric else f"TRY_CAST({c} AS DOUBLE)")
                conds = ["TRUE"]
                lo, hi = parse_bound(kw.get("min_value"), as_dt), parse_bound(kw.get("max_value"), as_dt)
                if lo is not None:
                    conds.append(f"{v} >= {_lit(lo)}")
                if hi is not None:
                    conds.append(f"{v} <= {_lit(hi)}")
                bad = f"NOT coalesce({' AND '.join(conds)}, FALSE)"
            else:
                raise ValueError(t)
            e = f"count({c})"
            u = f"count(CASE WHEN {c} IS NOT NULL AND {bad} THEN 1 END)"
            parts.append(row(i, t, c, e, u, f"CASE WHEN {e} > 0 THEN CAST({u} AS DOUBLE) / {e} END", _ok(e, u, mostly)))
    return f"WITH t AS ({table_sql})\n" + "\nUNION ALL\n".join(parts)


def row_failures_sql(suite: Sequence[dict], columns: Sequence[str], numeric: Sequence[str]) -> list[tuple[str, str]]:
    """(label, SQL failure condition) of every row-level rule, in suite order."""
    cols = set(columns)
    out = []
    for i, r in enumerate(suite):
        t, kw = r["expectation_type"], r["kwargs"]
        c = kw.get("column")
        label = f"{i}:{t.replace('expect_', '')}:{kw.get('column', '')}"
        if t in PAIR:
            a, b = kw["column_A"], kw["column_B"]
            if a in cols and b in cols:
                good = f"{a} = {b}" if t == "expect_column_pair_values_to_be_equal" else \
                    (f"{a} >= {b}" if kw.get("or_equal") else f"{a} > {b}")
                out.append((label, f"{a} IS NOT NULL AND {b} IS NOT NULL AND NOT ({good})"))
            continue
        if c is None or c not in cols:
            continue
        if t == "expect_column_values_to_not_be_null":
            out.append((label, f"{c} IS NULL"))
        elif t == "expect_column_values_to_match_regex":
            out.append((label, f"{c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), {_q(kw['regex'])})"))
        elif t == "expect_column_values_to_be_in_set":
            out.append((label, f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(_q(v) for v in kw['value_set'])})"))
        elif t == "expect_column_values_to_be_between":
            as_dt = bool(kw.get("parse_strings_as_datetimes"))
            v = f"TRY_CAST({c} AS TIMESTAMP)" if as_dt else \
                (f"CAST({c} AS DOUBLE)" if c in numeric else f"TRY_CAST({c} AS DOUBLE)")
            conds = ["TRUE"]
            lo, hi = parse_bound(kw.get("min_value"), as_dt), parse_bound(kw.get("max_value"), as_dt)
            if lo is not None:
                conds.append(f"{v} >= {_lit(lo)}")
            if hi is not None:
                conds.append(f"{v} <= {_lit(hi)}")
            out.append((label, f"{c} IS NOT NULL AND NOT coalesce({' AND '.join(conds)}, FALSE)"))
    return out
