"""Pieces of DuckDB SQL that the oracles share, with fixed values of their own."""

# Cells that stand for no value, and company suffixes left out of name keys.
PLACEHOLDERS = [
    "-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-", "--", "---", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "not applicable", "notavailable", "unknown", "", "#n/a", "#na",
]
NAME_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "gmbh", "co", "corp", "corporation", "company", "ag", "bv", "plc", "kg", "ug"]


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def clean(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ({quoted(PLACEHOLDERS)}) THEN NULL ELSE trim({x}) END"


def base_key(x: str) -> str:
    return f"nullif(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '')"


def name_key(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({base_key(x)}, '[,.\\-()]', ' ', 'g'), '\\b({'|'.join(NAME_SUFFIXES)})\\b', '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({bare}, '\\s+', ' ', 'g')), ''), {base_key(x)})"


def mpn_key(x: str) -> str:
    return f"nullif(regexp_replace(upper({x}), '[\\s\\-_/.\\\\]', '', 'g'), '')"


def strong(x: str) -> str:
    return f"coalesce(length({base_key(x)}) >= 20 AND len([t for t in string_split({base_key(x)}, ' ') if length(t) > 1]) >= 4, false)"


def fingerprint(x: str) -> str:
    return f"nullif(array_to_string(list_sort([u for u in [regexp_replace(t, '[^a-z0-9]', '', 'g') for t in string_split({base_key(x)}, ' ')] if length(u) > 1])[1:12], '|'), '')"


def vendor(x: str) -> str:
    return f"coalesce(nullif(regexp_replace({x}, '\\s*\\([A-Z0-9]{{1,6}}\\)\\s*$', ''), ''), {x})"


def number(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '[,\\s]', '', 'g'), '^\\+', '')"
    return f"CASE WHEN regexp_full_match({s}, '-?[0-9]+(\\.[0-9]+)?') THEN TRY_CAST({s} AS DOUBLE) END"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[\\s-]', '', 'g')"


def valid_gtin(d: str) -> str:
    weights = f"[TRY_CAST(substr({d}, length({d}) - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END for i in range(1, length({d}))]"
    return f"coalesce(regexp_full_match({d}, '[0-9]{{8}}|[0-9]{{12}}|[0-9]{{13}}|[0-9]{{14}}') AND (10 - list_sum({weights}) % 10) % 10 = TRY_CAST(right({d}, 1) AS INTEGER), false)"


MEASURE = "^(-?[0-9.,]+)\\s*([A-Za-z]{1,6})\\.?$"
