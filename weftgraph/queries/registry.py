"""Collecting queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.knowledge import Knowledge, frame, portable

#: Aggregates that the engines spell differently: (here, elsewhere), with {0} the argument.
_MACROS = {
    "SORTED_LIST": ("array_join(array_sort(collect_set({0})), ',')", "string_agg(DISTINCT {0}, ',' ORDER BY {0})"),
    "FIRST_EIGHT": ("array_join(slice(array_sort(collect_set({0})), 1, 8), ',')", "array_to_string(list_sort(list(DISTINCT {0}))[1:8], ',')"),
    "FIRST_FIVE": ("array_join(slice(array_sort(collect_set({0})), 1, 5), ',')", "array_to_string(list_sort(list(DISTINCT {0}))[1:5], ',')"),
    "FIRST_THREE": ("array_join(slice(array_sort(collect_set({0})), 1, 3), ',')", "array_to_string(list_sort(list(DISTINCT {0}))[1:3], ',')"),
    "MEDIAN_OF": ("percentile({0}, 0.5)", "quantile_cont({0}, 0.5)"),
}


def _spelled(sql: str, which: int) -> str:
    for name, forms in _MACROS.items():
        while (at := sql.find(name + "(")) >= 0:
            depth, end = 0, at + len(name)
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if not depth:
                    break
            sql = sql[:at] + forms[which].replace("{0}", sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Callable[[Knowledge], DataFrame], sql: str | None = None) -> None:
        """An operator of the library over a `Knowledge`, with its SQL if it can be said in SQL."""
        self.queries[name] = lambda spark, folder: run(Knowledge(spark, folder))
        if sql is not None:
            self.oracles[name] = portable(_spelled(sql, 1))

    def shared(self, name: str, sql: str) -> None:
        """A query that is one SQL text for every engine."""
        self.queries[name] = lambda spark, folder: frame(spark, folder, _spelled(sql, 0))
        self.oracles[name] = portable(_spelled(sql, 1))
