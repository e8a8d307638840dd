"""All checked queries: name -> Spark callable and name -> DuckDB SQL."""

from . import agent, cleaning, insight, missing, outliers, profile, questions, sources

MODULES = (sources, profile, cleaning, missing, outliers, insight, questions, agent)

QUERIES: dict = {}
ORACLE: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
