"""The two tool functions a tool server would offer: query and graph_neighbors.

The transport is left to the server; these functions keep its contract: a missing or incomplete
store is an error at the start, errors of the engine come back as error results, others are raised.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from vaultmill.errors import StoreError, ToolStartError, VaultError
from vaultmill.operators.embed import Embedder
from vaultmill.plans.query import Engine
from vaultmill.plans.store import Store


@dataclass
class ToolResult:
    text: str
    is_error: bool = False

    @property
    def rows(self) -> list[dict]:
        return json.loads(self.text)


class Tools:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder):
        try:
            self.engine = Engine(spark, Store.open(spark, root), embedder)
        except StoreError as e:
            raise ToolStartError(str(e)) from e

    def _run(self, make) -> ToolResult:
        try:
            return ToolResult(json.dumps([r.asDict() for r in make().collect()], indent=2))
        except VaultError as e:
            return ToolResult(str(e), True)

    def query(self, question: str, **options) -> ToolResult:
        return self._run(lambda: self.engine.query(question, **options))

    def graph_neighbors(self, doc_id: str) -> ToolResult:
        def rows():
            self.engine.require(doc_id)
            return self.engine.neighbors(doc_id)

        return self._run(rows)
