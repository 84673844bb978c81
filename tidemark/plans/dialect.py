"""The few functions that Spark SQL and the checking engine spell differently; queries are written once for both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    spark: bool
    sf_dir: str = ""

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`" if self.spark else name

    def us(self, ts: str) -> str:
        """Microseconds since the epoch of a timestamp."""
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us({ts})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS {'STRING' if self.spark else 'VARCHAR'})"

    def days(self, ts: str) -> str:
        """Days since the epoch of a timestamp."""
        return f"CAST(floor({self.us(ts)} / 86400000000) AS INT)"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def span(self, low: str, high: str, name: str) -> str:
        """A relation of one column with every integer from low to high."""
        if self.spark:
            return f"(SELECT explode(sequence({low}, {high})) AS {name})"
        return f"(SELECT unnest(generate_series({low}, {high})) AS {name})"


DUCK = Dialect(False)
Text = Callable[[Dialect], str]


def with_tables(d: Dialect, body: str, ctes: dict[str, tuple[Text, tuple[str, ...]]]) -> str:
    """The body after the WITH list of the domain tables that it names, and those that they need."""
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name, (define, _) in ctes.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(define(d))
                if name not in needed:
                    needed.append(name)

    add(body)
    head = ",\n".join(f"{n} AS ({ctes[n][0](d)})" for n in needed)
    body = body.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


def query(text: Text, ctes) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A registered query and its SQL."""
    return (lambda spark, sf_dir: spark.sql(with_tables(d := Dialect(True, sf_dir), text(d), ctes))), with_tables(DUCK, text(DUCK), ctes)
