"""The engine's surface: scan, query, impact, learn and reset over one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import store
from .operators.graph import CodeGraph
from .plans import router
from .session import cut
from .sources import manifests, scan

GUIDE = """Ask in words or with SQL: behind the prefix.
- circular function calls; repository api cycles (cycle ... service ... api)
- impact of endpoint '/users'; affected files for file 'src/a.ts'
- which provided endpoints in 'repo'; which consumed endpoints in 'repo'
- who calls 'getUser'; configs in file 'src/a.ts'
- any other words: search over endpoints, functions, files, then everything
SQL reads the views nodes (all stored columns) and edges (fromId, type, toId, relKey, properties)."""


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.graph = spark, CodeGraph(spark, folder)

    def scan(self, root: str, **globs) -> dict[str, DataFrame]:
        """Files and packages below a root."""
        files = scan.scan(self.spark, root, **globs)
        every = scan.scan(self.spark, root, includes=("**",), **{k: v for k, v in globs.items() if k != "includes"})
        return {"files": files, "packages": manifests.dependencies(every.select("repoRoot", F.col("relPath").alias("file"), "content"))}

    def query(self, prompt: str, limit: float | None = None) -> DataFrame:
        return router.run(self.graph, prompt, limit)

    def impact(self, file: str, depth: float = 3, repo_root: str | None = None) -> DataFrame:
        return router.impact(self.graph, file, depth, repo_root)

    def impact_report(self, file: str, depth: float = 3, repo_root: str | None = None) -> str:
        return "\n".join(router.report(router.impact_lists(self.graph, file, depth, repo_root)))

    def learn(self) -> str:
        return GUIDE

    def reset(self, repo_root: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """Nodes and edges that are left without one repository, or empty frames, and their numbers before and after."""
        n, e = cut(self.graph.nodes), cut(self.graph.edges().select("fromId", "type", "toId"))
        if repo_root is None:
            return store.reset_all(n, e)
        left, kept = store.reset_repository(n, e, repo_root)
        return left, kept, {"nodes": n.count(), "edges": e.count(), "nodesLeft": left.count(), "edgesLeft": kept.count()}
