"""Questions to plans, by rules. Pure Python on the question; no data is touched."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import get_close_matches

from quaestor.nl import vocabulary as V
from quaestor.plans.plan import Filter, Measure, QueryPlan, Sort
from quaestor.sources.readers import Dataset

_NUMBER = r"-?\d+(?:\.\d+)?"


def has(question: str, phrases) -> bool:
    return first_of(question, phrases) is not None


def first_of(question: str, phrases) -> str | None:
    """The first of the phrases that stands in the question as whole words."""
    low = question.lower()
    return next((p for p in phrases if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", low)), None)


def spellings(column: str) -> list[str]:
    """A column's name as it may stand in a question."""
    spaced = re.sub(r"[_\-]+", " ", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", column)).lower()
    return list(dict.fromkeys([column.lower(), spaced]))


def mentions(question: str, columns: list[str]) -> list[tuple[int, int, str]]:
    """(begin, end, column) of whole-word mentions, longest names first, without overlap, in order."""
    low, found = question.lower(), []
    for name, column in sorted(((s, c) for c in columns for s in spellings(c)), key=lambda x: -len(x[0])):
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", low):
            if all(m.end() <= a or m.start() >= b for a, b, _ in found):
                found.append((m.start(), m.end(), column))
    return sorted(found)


def without_columns(question: str, columns: list[str]) -> str:
    """The question with blanks where columns are named, so that their names aren't read as words."""
    out = question
    for a, b, _ in mentions(question, columns):
        out = out[:a] + " " * (b - a) + out[b:]
    return out


def resolve(term: str, columns: list[str]) -> str | None:
    """A column by name in any case, else one whose name holds the term or is held by it, in schema order."""
    low = re.sub(r"[\s_\-]+", "", term.lower())
    if not low:
        return None
    flat = {c: re.sub(r"[\s_\-]+", "", c.lower()) for c in columns}
    exact = next((c for c, f in flat.items() if f == low), None)
    if exact or len(low) < 3:
        return exact
    return next((c for c, f in flat.items() if low in f or (len(f) >= 3 and f in low)), None)


def _value(text: str):
    text = text.strip().strip("?.!;").strip().strip("'\"")
    return float(text) if re.fullmatch(_NUMBER, text) and "." in text else int(text) if re.fullmatch(_NUMBER, text) else text


def _operators() -> list[tuple[str, str]]:
    """(phrase, operator), longer phrases first."""
    return sorted(((p, op) for op, ps in V.COMPARISONS.items() for p in ps), key=lambda x: -len(x[0]))


_STOP = r"(?=\s+(?:and|or|group(?:ed)?\s+by|by|per|for each|sort(?:ed)?\s+by|order(?:ed)?\s+by|limit|in\s+(?:these|those|them))(?!\w)|[?;]|$)"


def conditions(question: str, columns: list[str]) -> list[Filter]:
    """Filters that the question states: a column, an optional copula, a comparison, and a value of any number of words."""
    out = []
    for a, b, column in mentions(question, columns):
        rest = question[b:]
        for phrase, op in _operators():
            edge = r"(?!\w)" if phrase[-1].isalnum() else ""
            m = re.match(rf"\s*(?:(?:value|values)\s+)?(?:(?:is|are|that is)\s+)?{re.escape(phrase)}{edge}\s*(\"[^\"]+\"|'[^']+'|.+?){_STOP}", rest, re.I)
            if m and m[1].strip():
                value = _value(m[1])
                if op in (">", "<", ">=", "<=") and isinstance(value, str):
                    continue
                if phrase in ("is", "are", "=") and re.match(r"(?:above|below|over|under|at|greater|less|more|lower|higher|not)\b", str(value)):
                    continue
                out.append(Filter(column, op, value))
                break
        else:
            m = re.match(rf"\s+contain(?:s|ing)\s+(\"[^\"]+\"|'[^']+'|.+?){_STOP}", rest, re.I)
            if m:
                out.append(Filter(column, "contains", _value(m[1])))
    return out


def group_columns(question: str, columns: list[str]) -> list[str]:
    m = re.search(r"(?<!\w)(?:grouped by|group by|by|per|for each)\s+", question, re.I)
    if not m or re.search(r"(?:sort|order)(?:ed)?\s+$", question[: m.start()], re.I):
        return []
    out, rest = [], question[m.end() :]
    while found := next(((a, b, c) for a, b, c in mentions(rest, columns) if a == 0), None):
        out.append(found[2])
        rest = re.sub(r"^\s*(?:,|and)\s*", "", rest[found[1] :])
    return out


def _of_groups(question: str, columns: list[str]) -> tuple[str, tuple[Filter, ...], str]:
    """(the question without what it says of groups, filters after "having", rollup or cube). Counts of a group are asked as "count"."""
    m = re.search(r"\s+having\s+(.+)$", question, re.I)
    having = tuple(Filter("Count" if f.column == "count" else f.column, f.operator, f.value) for f in conditions(m[1], ["count", *columns])) if m else ()
    question = question[: m.start()] if having else question
    for words, kind in ((r"with (?:sub)?totals", "rollup"), (r"(?:in|for) all combinations", "cube")):
        if found := re.search(rf",?\s+{words}(?!\w)", question, re.I):
            return question[: found.start()] + question[found.end() :], having, kind
    return question, having, ""


def aggregation_of(question: str, columns: list[str]) -> str | None:
    bare = without_columns(question, columns)
    return next((f for f, words in V.AGGREGATIONS.items() if has(bare, words)), None)


def ordering(question: str, columns: list[str]) -> tuple[Sort, ...]:
    m = re.search(r"(?:sort|order)(?:ed)?\s+by\s+(.*)", question, re.I)
    if not m:
        return ()
    found = mentions(m[1], columns)
    return tuple(Sort(c, bool(re.match(r"\s*(?:desc|descending)\b", m[1][b:], re.I))) for _, b, c in found)


def limit_of(question: str) -> int | None:
    m = re.search(r"(?<!\w)(?:limit|first|top)\s+(\d+)(?!\w)", question, re.I)
    return int(m[1]) if m and int(m[1]) > 0 else None


def structured_plan(question: str, ds: Dataset) -> QueryPlan | None:
    """First that fits: aggregation, filter or comparison, column, statistics, count; None if nothing does."""
    columns = ds.columns
    q = question.strip().rstrip("?").strip()
    q, having, grouping = _of_groups(q, columns)
    where, keys = conditions(q, columns), group_columns(q, columns)
    tail = dict(filters=tuple(where), groupby=tuple(keys), having=having if keys else (), grouping=grouping if keys else "", sort=ordering(q, columns), limit=limit_of(q), source=question)
    used = {f.column for f in where} | set(keys) | {s.column for s in tail["sort"]}
    named = [c for _, _, c in mentions(q, columns)]
    free = [c for c in named if c not in used]
    function = aggregation_of(q, columns)
    if function == "count":
        if free and not where and not keys:
            return QueryPlan("aggregate", (free[0],), (Measure(free[0], "count"),), **tail)
        return QueryPlan("count", **tail)
    if function and not (function == "max" and tail["limit"]):
        target = free[0] if free else None
        if target is None:
            words = [w for w in re.findall(r"\w+", without_columns(q, columns)) if not has(w, sum(V.AGGREGATIONS.values(), ())) and len(w) >= 4]
            target = next((c for c in (resolve(w, columns) for w in words) if c and c not in used), None)
        if target and (ds.kinds[target] == "numeric" or function in ("max", "min")):
            return QueryPlan("aggregate", (target,), (Measure(target, function),), **tail)
    if has(without_columns(q, columns), ("unique", "distinct")) and named:
        return QueryPlan("distinct", (named[0],), **{**tail, "groupby": ()})
    if where:
        return QueryPlan("list", tuple(free), **tail)
    if free and re.match(r"(?:show|display|get|list|give me|what is|what are)\b", q, re.I):
        return QueryPlan("list", tuple(dict.fromkeys(free)), **tail)
    if has(q, V.STATISTICS) or has(q, ("summarize",)):
        return QueryPlan("summarize", tuple(named), **tail)
    if tail["sort"] or (tail["limit"] and has(q, V.OPERATIONS["show"])):
        return QueryPlan("list", (), **tail)
    return None


def route(question: str, columns: list[str]) -> str:
    """structured, semantic or hybrid."""
    bare, named = without_columns(question, columns), bool(mentions(question, columns))
    structured = bool(conditions(question, columns)) or (named and has(bare, V.SHOW + V.LOOKUP)) or (named and any(has(bare, w) for w in V.AGGREGATIONS.values()))
    structured = structured or has(bare, ("how many records", "how many rows", "count records", "total records", "number of records"))
    semantic = has(bare.lower().replace("how many", "").replace("how much", ""), V.SEMANTIC + V.SEMANTIC_FORMS)
    if structured and not semantic:
        return "structured"
    return "hybrid" if structured or not semantic else "semantic"


def complexity(question: str) -> str:
    return next((k for k, words in V.COMPLEXITY.items() if has(question, words)), "medium")


@dataclass(frozen=True)
class Intent:
    kind: str
    complexity: str
    columns: tuple[str, ...]
    operations: tuple[str, ...]
    filters: tuple[Filter, ...]
    aggregations: tuple[str, ...]


def intent(question: str, columns: list[str]) -> Intent:
    bare = without_columns(question, columns)
    return Intent(
        route(question, columns), complexity(question), tuple(dict.fromkeys(c for _, _, c in mentions(question, columns))),
        tuple(k for k, w in V.OPERATIONS.items() if has(bare, w)), tuple(conditions(question, columns)), tuple(f for f, w in V.AGGREGATIONS.items() if has(bare, w)),
    )


@dataclass(frozen=True)
class Info:
    """What a question is about: the column it wants, and the column and value that tell the rows."""

    target_column: str | None = None
    id_column: str | None = None
    id_value: str | None = None
    comparison: Filter | None = None
    command: str | None = None
    correction: str | None = None
    help: bool = False


def question_info(question: str, columns: list[str]) -> Info:
    """The target follows a request ("what is the ..."); the id column is another that a value follows, or the first one for a question of one or two words alone."""
    if is_help(question):
        return Info(command="help", help=True)
    q = question.strip().rstrip("?.! ")
    found = mentions(q, columns)
    compared = next((f for f in conditions(q, columns) if isinstance(f.value, (int, float))), None)
    asked = re.compile(r"(?:what(?:'s| is| are)|(?:tell|show|give) me|find|get|retrieve)\s+(?:the\s+)?$", re.I)
    target = next((c for a, _, c in found if asked.search(q[:a])), None)
    column = value = None
    for _, end, c in found:
        follows = re.match(r"\s*(?:(?:is|=|:)\s*)?(\"[^\"]+\"|'[^']+'|[\w.\-]+)", q[end:])
        word = follows and follows[1].strip("'\"")
        if c != target and word and word.lower() not in V.LINKS and (compared is None or compared.column != c):
            column, value = c, word
            break
    if column is None and not found and columns and 0 < len(q.split()) <= 2:
        column, value = columns[0], q
    return Info(target, column, value, compared, next((c for c in ("summarize", "list", "count") if has(q, (c,))), None), corrected_command(q))


def corrected_command(question: str) -> str | None:
    """The command that the first word misspells, if it is none itself."""
    word = re.match(r"\s*([a-z]+)", question.lower())
    if not word or word[1] in V.COMMANDS or len(word[1]) < 3:
        return None
    close = get_close_matches(word[1], V.COMMANDS, 1, 0.75)
    return close[0] if close else None


def is_help(question: str) -> bool:
    return question.lower().strip().rstrip("?").strip() in V.HELP


def is_analysis(question: str, columns: list[str]) -> bool:
    return has(without_columns(question, columns), V.ANALYSIS) and "summarize by" not in question.lower()


def is_complex(question: str, columns: list[str]) -> bool:
    bare = without_columns(question, columns).lower()
    both = has(bare, ("analysis", "analyze", "statistics", "stats")) and has(bare, ("where", "with", "containing", "records are", "for records"))
    return both or bool(re.search(r"records\s+(?:that\s+are\s+|are\s+)?(?:with|containing|having|about|not|without)\s+\w|all records are\s+\w", bare))


def keyword_of(question: str) -> str | None:
    m = re.search(r"records\s+(?:are|with|containing|having|about)\s+(?:the\s+)?([\w'-]+)", question, re.I)
    return m[1] if m else None
