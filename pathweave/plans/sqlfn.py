"""DuckDB expression text for the scalar functions (oracle side only)."""

from __future__ import annotations

BL = "'[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']'"
CS_KEEP = "('0', '1', '2', '3', '4', '5', '10')"


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def h1(x: str, default: str = "BLANK") -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '\\\\n', '', 'g')"
    s = f"regexp_replace({s}, '//s+', '', 'g')"
    s = f"regexp_replace({s}, '[\"'',]', '', 'g')"
    s = f"regexp_replace({s}, '[^\\x20-\\x7E]', '', 'g')"
    stripped = f"regexp_replace({s}, '[^A-Za-z]', '', 'g')"
    careful = f"replace({s}, ' ', '_')"
    return (f"(CASE WHEN length({stripped}) > 0 THEN {stripped} "
            f"WHEN length({careful}) > 0 THEN {careful} ELSE '{default}' END)")


def _split_parts(x: str) -> str:
    t = jtrim(x)
    t = f"regexp_replace({t}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    parts = f"regexp_split_to_array({t}, '_|[0-9]|[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+')"
    return f"list_filter({parts}, lambda p: length(p) > 0)"


def h2(x: str) -> str:
    return (f"list_filter(list_transform({_split_parts(x)}, lambda q: {h1('q', '')}), "
            f"lambda r: length(r) > 0)")


def h3(x: str) -> str:
    s = f"lower({x})"
    s = f"replace({s}, '\\\\n', '')"
    s = f"replace({s}, '[\"'',]', '')"
    s = f"regexp_replace({s}, {BL}, '', 'g')"
    s = f"regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g')"
    s = f"replace({s}, ',', 'C')"
    letters = f"regexp_replace({s}, '[^A-Za-z]', '', 'g')"
    return (f"(CASE WHEN length({letters}) > 0 THEN {letters} "
            f"WHEN regexp_matches({s}, '^[0-9]+$') AND {s} IN {CS_KEEP} THEN {s} "
            f"WHEN regexp_matches({s}, '^[0-9]+$') THEN 'NUM' ELSE '' END)")


def h4(x: str) -> str:
    return (f"list_filter(list_transform({_split_parts(x)}, lambda q: {h3('q')}), "
            f"lambda r: length(r) > 0)")


def h5(x: str) -> str:
    joined = f"array_to_string({h4(x)}, '|')"
    name = f"(CASE WHEN length({joined}) > 0 THEN {joined} ELSE {h3(x)} END)"
    name = f"(CASE WHEN length(regexp_replace({name}, {BL}, '', 'g')) = 0 THEN 'SPACE' ELSE {name} END)"
    return f"(CASE WHEN {x} = 'METHOD_NAME' THEN {x} ELSE {name} END)"


def h6(x: str) -> str:
    stripped = f"regexp_replace({x}, '[^a-zA-Z]', '', 'g')"
    return f"(CASE WHEN length({stripped}) = 0 THEN lower({x}) ELSE lower({stripped}) END)"


def h8(x: str) -> str:
    h = (f"list_reduce(list_transform(string_split({x}, ''), lambda ch: ascii(ch)::bigint), "
         f"lambda acc, v: (acc * 31 + v) % 4294967296, 0::bigint)")
    return f"cast(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END AS int)"


def h17(x: str) -> str:
    s = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(9), ' ')"
    s = f"(CASE WHEN starts_with({s}, '{{' || chr(10)) THEN {jtrim(f'substr({s}, 4)')} ELSE {s} END)"
    s = (f"(CASE WHEN ends_with({s}, chr(10) || '}}') THEN {jtrim(f'substr({s}, 1, length({s}) - 2)')} "
         f"ELSE {s} END)")
    body = f"regexp_replace({s}, chr(10) || '+$', '')"
    kept = (f"len(list_filter(string_split({body}, chr(10)), lambda ln: NOT starts_with({jtrim('ln')}, '/') "
            f"AND NOT starts_with({jtrim('ln')}, '*')))")
    return f"cast(CASE WHEN length({s}) = 0 THEN 0 WHEN length({body}) = 0 THEN 0 ELSE {kept} END AS bigint)"
