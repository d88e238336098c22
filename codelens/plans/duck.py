"""DuckDB SQL text helpers for the oracle queries (RE2 regexes, as the source tool uses)."""

from __future__ import annotations

from codelens.functions import catalogs as C
from codelens.functions.text import any_of
from codelens.plans.registry import sql_str

WS = r"[\t\n\f\r ]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def extract(x: str, pat: str, idx: int = 1) -> str:
    p = sql_str(pat)
    return f"CASE WHEN regexp_matches({x}, {p}) THEN regexp_extract({x}, {p}, {idx}) END"


def to_int(x: str) -> str:
    return f"coalesce(TRY_CAST({x} AS BIGINT), 0)"


def matches(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {sql_str(pat)})"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def first_match_fields(lang: str, line: str = "line") -> dict[str, str]:
    """CASE expressions giving the first matching catalog pattern's fields."""
    pats = C.LANGUAGE_PATTERNS[lang]
    fields: dict[str, list[str]] = {k: [] for k in ("source", "file", "line_number", "column", "type", "severity")}
    for pattern, etype, sev, file_re, line_re, col_re in pats:
        cond = matches(line, pattern)
        fields["source"].append(f"WHEN {cond} THEN {sql_str(lang)}")
        fields["file"].append(f"WHEN {cond} THEN {extract(line, file_re) if file_re else 'NULL'}")
        fields["line_number"].append(f"WHEN {cond} THEN {to_int(extract(line, line_re)) if line_re else '0'}")
        fields["column"].append(f"WHEN {cond} THEN {to_int(extract(line, col_re)) if col_re else '0'}")
        fields["type"].append(f"WHEN {cond} THEN {sql_str(etype)}")
        fields["severity"].append(f"WHEN {cond} THEN {sql_str(sev)}")
    out = {k: "CASE " + " ".join(v) + " END" for k, v in fields.items()}
    out["line_number"] = f"CAST({out['line_number']} AS BIGINT)"
    out["column"] = f"CAST({out['column']} AS BIGINT)"
    out["hit"] = "(" + " OR ".join(matches(line, p[0]) for p in pats) + ")"
    return out


def first_match_select(lang: str, line: str = "line", message: str | None = None, severity: bool = True) -> str:
    f = first_match_fields(lang, line)
    msg = message or line
    sev = f"{f['severity']} AS severity, " if severity else ""
    return (f"{f['source']} AS source, {f['file']} AS file, {f['line_number']} AS line_number, "
            f"{f['column']} AS column, {f['type']} AS type, {sev}{msg} AS message, '' AS code")


def process_gate(custom=()) -> str:
    return matches("line", any_of(list(C.PROCESS_ERROR_PATTERNS) + list(custom)))


def severity_expr(line: str = "line") -> str:
    return f"CASE WHEN {matches(line, C.WARNING_PATTERN)} THEN 'warning' ELSE 'error' END"


def error_type_expr(line: str = "line") -> str:
    whens = " ".join(f"WHEN {matches(line, p)} THEN {sql_str(n)}" for n, p in C.ERROR_TYPE_PATTERNS)
    return f"CASE {whens} ELSE {sql_str(C.DEFAULT_ERROR_TYPE)} END"
