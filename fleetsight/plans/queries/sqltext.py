"""SQL pieces for the checks: the views, rank tables and redaction patterns of the engine."""

from __future__ import annotations

from fleetsight import constants as K
from fleetsight.functions.redact import SENSITIVE_ASSIGNMENT
from fleetsight.plans.fixtures import ARRAYS, select_list


# The blanks of the engine, for regular expressions without a Unicode switch.
BLANK = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def portable(pattern: str) -> str:
    """A pattern of the engine without the Unicode switch."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\s\x1c-\x1f", BLANK)


def cte(*views: str) -> str:
    """``WITH`` clause that defines the named views."""
    from fleetsight.plans.fixtures import VIEWS

    parts = []
    for view in views:
        lists = ""
        if view == "records":
            lists = "".join(
                f", list_filter([{', '.join(parts_)}], lambda x: x IS NOT NULL) AS {name}" for name, parts_ in ARRAYS.items()
            ) + ", url_1 AS canonical_source_url"
        parts.append(f"{view}_0 AS (SELECT {select_list(view)} FROM {VIEWS[view][0]}), {view} AS (SELECT *{lists} FROM {view}_0)")
    return "WITH " + ", ".join(parts) + " "


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(names) -> str:
    return ", ".join(f"({quoted(name)})" for name in names)


def in_list(names) -> str:
    return "(" + ", ".join(quoted(name) for name in names) + ")"


def rank(column: str, ordered) -> str:
    whens = " ".join(f"WHEN {quoted(name)} THEN {position}" for position, name in enumerate(ordered))
    return f"CASE {column} {whens} ELSE 0 END"


def level_at_least(column: str, floor: str) -> str:
    names = "[" + ", ".join(quoted(name) for name in K.RISK_LEVELS) + "]"
    return f"{names}[greatest({rank(column, K.RISK_LEVELS)}, {K.RISK_LEVELS.index(floor)}) + 1]"


def any_term(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(term)})" for term in terms) + ")"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, {quoted(f'[{BLANK}]+')}, ' ', 'g'))"


def normalized(text: str) -> str:
    return squeeze(f"lower(coalesce({text}, ''))")


def sensitive(text: str) -> str:
    return f"coalesce(regexp_matches({text}, {quoted(portable(SENSITIVE_ASSIGNMENT))}), FALSE)"


def safe(text: str) -> str:
    return f"CASE WHEN {sensitive(text)} THEN NULL ELSE {text} END"


def micros(column: str) -> str:
    return f"epoch_us({column})"


def moment(column: str) -> str:
    """Time as text, the same in both engines."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
