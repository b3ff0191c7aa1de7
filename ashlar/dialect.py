"""The SQL dialect on top of Spark's: a query may omit FROM, and name files in FROM and JOIN.

Works on tokens, so strings, comments and nested queries are left alone; all else is Spark's parser's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ashlar.errors import DialectError

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|(?P<quoted>`[^`]*`)|(?P<word>[A-Za-z_][\w$]*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<sign><=|>=|<>|!=|\|\||.)", re.S)
#: After these the select list is over.
_CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT"}
EXTENSIONS = {"parquet", "avro", "orc", "csv", "json"}


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TOKEN.finditer(sql):
        if m.start() != at:
            raise DialectError(f"cannot read {sql[at : at + 20]!r}")
        at = m.end()
        out.append((m.lastgroup or "", m[0]))
    if any(kind == "sign" and text in "'\"" for kind, text in out):
        raise DialectError("a string does not end")
    return out


def rewrite(sql: str, view_of: Callable[[str], str | None], default: str | None) -> str:
    """The text for ``spark.sql``.

    view_of(path) registers a file and gives its view's name, or None if the name is no file; default is the view of
    queries that have no FROM and name a column.
    """
    toks = tokens(sql.strip().rstrip(";"))
    code = [i for i, (kind, _) in enumerate(toks) if kind != "space"]
    out = [text for _, text in toks]
    word = lambda k: toks[code[k]][1].upper() if 0 <= k < len(code) and toks[code[k]][0] == "word" else ""
    k = 0
    while k < len(code):
        if word(k) in ("FROM", "JOIN") and k + 1 < len(code):
            kind, text = toks[code[k + 1]]
            if kind == "string":
                name = text[1:-1]
                view = view_of(name)
                if view is None:
                    raise DialectError(f"no such file: {name}")
                out[code[k + 1]] = view
                k += 1
            elif kind == "word":  # name.ext, one token after the other with nothing between
                last = k + 1
                while last + 2 < len(code) and toks[code[last + 1]][1] == "." and code[last + 2] == code[last] + 2 and toks[code[last + 2]][0] == "word":
                    last += 2
                name = "".join(toks[code[j]][1] for j in range(k + 1, last + 1))
                if last > k + 1 and (view := view_of(name)) is not None:
                    for j in range(k + 1, last + 1):
                        out[code[j]] = view if j == k + 1 else ""
                    k = last
        k += 1
    if default is not None and word(0) == "SELECT" and not _has_from(code, toks, word):
        at = _end_of_list(code, toks, word)
        if at < len(code) or _names_a_column(code, toks, at):
            place = code[at - 1] + 1
            out.insert(place, f" FROM {default}")
    return "".join(out)


def _depths(code: list[int], toks: list[tuple[str, str]]) -> list[int]:
    depth, out = 0, []
    for i in code:
        depth += {"(": 1, ")": -1}.get(toks[i][1], 0)
        out.append(depth)
    return out


def _has_from(code, toks, word) -> bool:
    depths = _depths(code, toks)
    return any(word(k) == "FROM" and depths[k] == 0 for k in range(len(code)))


def _end_of_list(code, toks, word) -> int:
    depths = _depths(code, toks)
    return next((k for k in range(1, len(code)) if depths[k] == 0 and word(k) in _CLAUSES), len(code))


_CONSTANTS = {"NULL", "TRUE", "FALSE", "AS", "CAST", "DATE", "TIMESTAMP", "INTERVAL"}


def _names_a_column(code, toks, end: int) -> bool:
    """Whether a select list needs a table: it has a star or a name that is no alias, function or literal."""
    for k in range(1, end):
        kind, text = toks[code[k]]
        after = toks[code[k + 1]][1] if k + 1 < len(code) else ""
        before = toks[code[k - 1]][1].upper()
        if text == "*" and (before in ("SELECT", ",", "DISTINCT", ".") or before == "("):
            return True
        if kind in ("word", "quoted") and text.upper() not in _CONSTANTS | {"DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT"} and after != "(" and before not in ("AS", ")") and toks[code[k - 1]][0] not in ("number", "string"):
            return True
    return False
