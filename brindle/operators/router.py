"""Messages routed by prefix; the longest prefix wins, an exact word can be a route of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The prefixes, and what each leads to here.
ROUTES = (("prefix-config:", "prefix-config"), ("ddl:", "tasks"), ("ddltodo:", "todo"), ("easy:", "next-action"), ("mat:", "memory"), ("cm:", "concept"), ("file:", "files"), ("fogg:", "design"), ("show:", "show"), ("list:", "list"), ("paper:", "papers"), ("pre:", "reading"), ("qa:", "questions"), ("yang:", "flow"), ("upgrade:", "upgrade"), ("money:", "ledger"), ("log:", "audit"))
EXACT = (("ddl", "tasks-mode"),)


def route(messages: DataFrame, routes: tuple[tuple[str, str], ...] = ROUTES, exact: tuple[tuple[str, str], ...] = EXACT) -> DataFrame:
    """Add route and args; null route for none. The table is a chain of conditions, longest prefix first, so no join is made."""
    text = F.ltrim("text")
    target, args = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, name in sorted(routes, key=lambda r: (len(r[0]), r[0])):
        hit = F.startswith(text, F.lit(prefix))
        target, args = F.when(hit, name).otherwise(target), F.when(hit, F.trim(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(args)
    for word, name in exact:
        target = F.when(F.trim("text") == word, name).otherwise(target)
    return messages.withColumn("route", target).withColumn("args", args)
