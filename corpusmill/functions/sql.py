"""DuckDB SQL for the text functions, for the oracles: the same definitions in the other dialect."""

from __future__ import annotations

SPACE = "[ \\t\\n\\r\\f]+"


def words(c: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}'), lambda x: x <> '')"


def n_words(c: str = "text") -> str:
    return f"len({words(c)})"


def count(c: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '{pattern.replace(chr(39), chr(39) * 2)}')) AS BIGINT)"


def lines(c: str = "text") -> str:
    return f"list_filter(string_split({c}, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '')"


def dup_line_ratio(c: str = "text") -> str:
    x = lines(c)
    return f"CASE WHEN len({x}) = 0 THEN 0.0 ELSE 1 - CAST(len(list_distinct({x})) AS DOUBLE) / len({x}) END"


def mean_word_length(c: str = "text") -> str:
    x = words(c)
    return f"CASE WHEN len({x}) > 0 THEN CAST(list_sum(list_transform({x}, lambda w: length(w))) AS DOUBLE) / len({x}) END"


def symbol_ratio(c: str = "text", kind: str = "script_aware") -> str:
    text = {"script_aware": "[\\p{L}\\p{M}\\p{N} \\t\\n\\r\\f]", "alnum": "[\\p{L}\\p{N} \\t\\n\\r\\f]", "selector": "[\\p{L}\\p{N} \\t\\n\\r\\f.,'\"\\-?!:;()]"}[kind]
    ratio = f"1 - CAST({count(c, text)} AS DOUBLE) / greatest(length({c}), 1)"
    return f"CASE WHEN length({c}) = 0 THEN 1.0 ELSE {ratio} END" if kind == "selector" else ratio


def has_any(c: str, stop: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"list_has_any({words(f'lower({c})')}, [{listed}])"


def keyed_hex(key: str, *cols: str) -> str:
    return f"sha256(concat_ws('|', '{key}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


def keyed_unit(key: str, *cols: str) -> str:
    return f"CAST(CAST('0x' || substr({keyed_hex(key, *cols)}, 1, 13) AS BIGINT) AS DOUBLE) / {16**13}.0"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str]) -> str:
    """A VALUES list as a derived table."""
    lit = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"
