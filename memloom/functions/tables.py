"""Tables inside texts that patterns cannot take apart: tables within tables, rows without an end tag, bodies of JSON."""

from __future__ import annotations

import json
import math
import re

_TAG = re.compile(r"<(/?)(table|thead|tbody|tfoot|tr|th)\b([^>]*)>", re.IGNORECASE)


def pieces(text: str) -> list[tuple[str, bool]]:
    """The text in order, as (piece, is a table): whole outermost tables, and what lies between. A table without an end reaches to the end."""
    out, depth, start, last = [], 0, 0, 0
    for m in _TAG.finditer(text):
        if m[2].lower() != "table":
            continue
        if not m[1]:
            if depth == 0:
                start = m.start()
                out.append((text[last:start], False))
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                last = m.end()
                out.append((text[start:last], True))
    out.append((text[start:], True) if depth else (text[last:], False))
    return [(p, table) for p, table in out if p.strip()]


def rows_of(table: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """(opening tag, rows) of an HTML table: rows as (wrapper, text, is a header), those of inner tables left inside theirs. A row without an
    end tag ends where the next one, its wrapper or the table does."""
    head = _TAG.match(table)
    out: list[tuple[str, str, bool]] = []
    depth, wrapper, start, header = 0, "", -1, False

    def close(end: int) -> None:
        nonlocal start, header
        if start >= 0:
            body = table[start:end]
            out.append((wrapper, body if re.search(r"</tr\s*>\s*$", body, re.IGNORECASE) else body.rstrip() + "</tr>", header or wrapper == "thead"))
        start, header = -1, False

    for m in _TAG.finditer(table):
        name, ends = m[2].lower(), bool(m[1])
        if name == "table":
            if ends and depth == 1:
                close(m.start())
            depth += -1 if ends else 1
        elif depth != 1:
            continue
        elif name == "tr":
            if ends:
                close(m.end())
            else:
                close(m.start())
                start = m.start()
        elif name == "th":
            header = header or start >= 0
        else:
            close(m.start())
            wrapper = "" if ends else name
    close(len(table))
    return (head[0] if head else "<table>"), out


def joined(tag: str, rows: list[tuple[str, str, bool]]) -> str:
    """A table of these rows, each run of rows of one wrapper inside it."""
    out, open_ = [tag], ""
    for wrapper, row, _ in rows:
        if wrapper != open_:
            out += [f"</{open_}>"] * bool(open_) + [f"<{wrapper}>"] * bool(wrapper)
            open_ = wrapper
        out.append(row)
    return "".join([*out, *[f"</{open_}>"] * bool(open_), "</table>"])


def slices(table: str, most: int) -> list[str]:
    """A table as slices of nearly equal numbers of rows, as many as its tokens ask for at `most` each: of HTML with its header rows
    again, of a JSON list of rows with the same tag. What has no rows, or one, stays whole."""
    need = math.ceil(len(table.split()) / most)
    if need <= 1:
        return [table]
    head = _TAG.match(table)
    body = re.sub(r"</table\s*>\s*$", "", table[head.end() :], flags=re.IGNORECASE)
    if body.lstrip().startswith("["):
        try:
            rows = json.loads(body)
        except ValueError:
            rows = None
        if isinstance(rows, list) and len(rows) > 1:
            per = max(1, math.ceil(len(rows) / need))
            return [f"{head[0]}{json.dumps(rows[k : k + per], ensure_ascii=False)}</table>" for k in range(0, len(rows), per)]
        return [table]
    tag, rows = rows_of(table)
    top, rest = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if len(rest) < 2:
        return [table]
    per = max(1, math.ceil(len(rest) / need))
    return [joined(tag, [*top, *rest[k : k + per]]) for k in range(0, len(rest), per)]


def split(text: str, most: int) -> list[str]:
    """All parts of a text in order, its tables in slices."""
    return [s for p, table in pieces(text) for s in (slices(p, most) if table else [p])]
