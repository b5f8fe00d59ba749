"""Named tables that build one another, each written once: the engine's incremental workflow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import MissingInput


@dataclass
class Workflow:
    """Rules from a table's name to its builder and what it needs. A table is built when it isn't there, or when forced, or
    when a table that it needs was built in the same run; its folder is complete once Spark's commit marked it."""

    spark: SparkSession
    folder: str
    rules: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def rule(self, name: str, *needs: str):
        """Register a builder that takes the needed tables in order."""

        def register(make: Callable[..., DataFrame]):
            self.rules[name] = (make, needs)
            return make

        return register

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def done(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name), "_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def order(self, *targets: str) -> list[str]:
        """The targets and all they need, needs first. An unknown name or a circle raises."""
        out: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in open_:
                raise ValueError(f"tables need one another: {' -> '.join([*open_, name])}")
            if name not in self.rules:
                if self.done(name):
                    return
                raise MissingInput(f"no rule makes {name}, and {self.path(name)} is not there")
            open_.append(name)
            for n in self.rules[name][1]:
                visit(n)
            open_.pop()
            out.append(name)

        for t in targets:
            visit(t)
        return out

    def build(self, *targets: str, force: tuple[str, ...] = ()) -> list[str]:
        """Build what isn't there; returns the names of what was built, in order."""
        built: list[str] = []
        for name in self.order(*targets):
            make, needs = self.rules[name]
            if name in force or not self.done(name) or set(needs) & set(built):
                make(*[self.table(n) for n in needs]).write.mode("overwrite").parquet(self.path(name))
                built.append(name)
        return built

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
