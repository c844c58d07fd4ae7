"""Links that open a graph in a store's browser, without credentials."""

from __future__ import annotations

import json
from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from loomgraph.functions.ids import GRAPH_ID
from loomgraph.operators.project import DEFAULT_LIMIT, MAX_LIMIT, check_type_name

_ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)(?::([0-9]+))?(?:[/?#]|$)"


def credential_free_address(uri: Column) -> Column:
    """Scheme, host and port of a uri, lower-cased but for the port; user, path and query are left out. Null without scheme and host."""
    part = lambda i: F.regexp_extract(uri, _ADDRESS, i)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3))).otherwise("")
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), port))


def path_statement(graph_id: str, limit: int = DEFAULT_LIMIT, label: str = "FACT_ENTITY", relation: str = "FACT_RELATION") -> str:
    """The statement that shows a graph's paths in a property-graph browser."""
    if not GRAPH_ID.fullmatch(graph_id):
        raise ValueError(f"bad graph id {graph_id!r}")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    same = " AND ".join(f"{x}.graph_id = {json.dumps(graph_id)}" for x in ("s", "r", "t"))
    return f"MATCH p = (s:{check_type_name(label)})-[r:{check_type_name(relation)}]->(t:{check_type_name(label)}) WHERE {same} RETURN p ORDER BY r.edge_id LIMIT {limit}"


def path_statements(graph_id: Column, limit: int = DEFAULT_LIMIT, label: str = "FACT_ENTITY", relation: str = "FACT_RELATION") -> Column:
    """``path_statement`` for a column of graph ids; null for one that isn't a graph's."""
    statement = F.replace(F.lit(path_statement("fact_extraction_0", limit, label, relation)), F.lit("fact_extraction_0"), graph_id)
    return F.when(graph_id.rlike(rf"\A(?:{GRAPH_ID.pattern})\z"), statement)


def browser_links(base: str, uri: str, database: str, statement: Column) -> Column:
    """``browser_link`` for a column of statements."""
    address = credential_free_address(F.lit(uri))
    parts = (("dbms", address), ("db", F.lit(database)), ("cmd", F.lit("edit")), ("arg", statement))
    query = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parts))
    return F.when(address.isNotNull() & statement.isNotNull(), F.concat(F.lit(base.rstrip("?") + "?"), query))


def browser_link(spark: SparkSession, base: str, uri: str, database: str, statement: str) -> str:
    if not base:
        raise ValueError("no browser address is configured")
    address = spark.range(1).select(credential_free_address(F.lit(uri))).first()[0]
    if address is None:
        raise ValueError("the store's uri needs a scheme and a host")
    return f"{base.rstrip('?')}?{urlencode({'dbms': address, 'db': database, 'cmd': 'edit', 'arg': statement})}"
