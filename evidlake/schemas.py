"""Schemas of the evidence tables, in order of the versions that brought them. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

VERSIONS: tuple[tuple[str, dict[str, str]], ...] = (
    ("001_tenancy", {
        "tenants": "tenant_id string not null, slug string not null, display_name string not null, source_name string not null, repo_owner string not null, repo_name string not null, daily_token_budget bigint not null, created_at timestamp not null",
        "api_keys": "key_id string not null, tenant_id string not null, key_hash binary not null, created_at timestamp not null, revoked_at timestamp",
    }),
    ("002_evidence", {
        "commits": "tenant_id string not null, sha string not null, message string not null, author_name string, author_email string, authored_at timestamp not null, committed_at timestamp not null, url string not null, files array<struct<path:string,status:string,additions:int,deletions:int>>",
        "files_changed": "tenant_id string not null, sha string not null, path string not null, status string not null, additions int not null, deletions int not null",
        "issues": "tenant_id string not null, number int not null, title string not null, body string not null, state string not null, labels array<string> not null, author string, created_at timestamp not null, closed_at timestamp, url string not null",
        "pull_requests": "tenant_id string not null, number int not null, title string not null, body string not null, state string not null, merged_at timestamp, merge_commit_sha string, base_ref string not null, head_ref string not null, author string, created_at timestamp not null, url string not null",
        "releases": "tenant_id string not null, tag string not null, name string, body string not null, published_at timestamp, target_commitish string, url string not null",
    }),
    ("003_chunks", {
        "evidence_chunks": "tenant_id string not null, chunk_id bigint not null, entity_type string not null, entity_key string not null, chunk_index int not null, content string not null, token_count int not null",
        "embeddings": "tenant_id string not null, chunk_id bigint not null, model string not null, dim int not null, embedding array<float> not null",
    }),
    ("004_operational", {
        "ingest_checkpoints": "tenant_id string not null, entity_type string not null, cursor_value string, etag string, items_seen bigint not null, updated_at timestamp not null",
        "embedding_dead_letter": "dead_letter_id bigint not null, tenant_id string not null, chunk_id bigint not null, attempts int not null, last_error string not null, next_attempt_at timestamp not null, created_at timestamp not null",
        "token_usage": "tenant_id string not null, usage_date date not null, tokens_in bigint not null, tokens_out bigint not null, cost_usd decimal(12,6) not null",
    }),
)


def table_schema(name: str) -> str:
    """The schema of a table, of the last version that has it."""
    for _, tables in reversed(VERSIONS):
        if name in tables:
            return tables[name]
    raise KeyError(f"{name} is not a table of this engine")


def pending(applied: list[str]) -> list[str]:
    """Versions still to apply, in order. A gap or an unknown version is an error."""
    names = [n for n, _ in VERSIONS]
    if applied != names[: len(applied)]:
        raise ValueError(f"the applied versions {applied} are not the first of {names}")
    return names[len(applied) :]


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; a missing column is an error."""
    fields = StructType.fromDDL(table_schema(name)).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType) for f in fields])
