"""Graph patterns: MATCH as a chain of equi-joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_path(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """The bindings of a path such as `a-(e)->b<-(f)-c`; columns are reached as `a.x`.

    tables: nodes have a column `node`, edges `src` and `dst`. A node that comes again (`a-(e)->a`) closes a circle. Null ends bind nothing.
    """
    text = re.sub(r"\s", "", pattern)
    if not (m := re.match(r"\w+", text)):
        raise ValueError(f"not a pattern: {pattern!r}")
    out, at, bound, end = tables[m[0]].alias(m[0]), m[0], {m[0]}, m.end()
    hop = re.compile(r"(?:-\((\w+)\)->|<-\((\w+)\)-)(\w+)")
    while end < len(text):
        if not (m := hop.match(text, end)):
            raise ValueError(f"not a pattern: {pattern!r}")
        edge, to = m[1] or m[2], m[3]
        near, far = ("src", "dst") if m[1] else ("dst", "src")
        out = out.join(tables[edge].alias(edge), F.col(f"{at}.node") == F.col(f"{edge}.{near}"))
        reached = F.col(f"{edge}.{far}") == F.col(f"{to}.node")
        out = out.filter(reached) if to in bound else out.join(tables[to].alias(to), reached)
        bound.add(to)
        at, end = to, m.end()
    return out
