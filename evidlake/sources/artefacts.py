"""Artefacts as JSON files, the events that announce them, and manifests of what they must become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64url

#: The fields of each entity type's JSON form; a trailing ? may be null but must be there.
FIELDS = {
    "commit": "tenantId:string sha:string message:string authorName:string? authorEmail:string? authoredAt:timestamp committedAt:timestamp url:string files:array<struct<path:string,status:string,additions:int,deletions:int>>",
    "issue": "tenantId:string number:int title:string body:string state:string labels:array<string> author:string? createdAt:timestamp closedAt:timestamp? url:string",
    "pull_request": "tenantId:string number:int title:string body:string state:string mergedAt:timestamp? mergeCommitSha:string? baseRef:string headRef:string author:string? createdAt:timestamp url:string",
    "release": "tenantId:string tag:string name:string? body:string publishedAt:timestamp? targetCommitish:string? url:string",
}
CREATED = "Microsoft.Storage.BlobCreated"
SUBJECT = "/blobServices/default/containers/{container}/blobs/"


def _fields(kind: str) -> list[tuple[str, str, bool]]:
    out = []
    for part in FIELDS[kind].split():
        name, _, type_ = part.partition(":")
        out.append((name, type_.removesuffix("?"), type_.endswith("?")))
    return out


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def read_artefacts(rows: DataFrame, kind: str, column: str = "json") -> DataFrame:
    """Rows with `record` (struct of the kind's fields) and `fault`: one of them is null.

    Every field must be there, of its type; those that may be null may be null, and no other.
    """
    fields = _fields(kind)
    raw = F.from_json(column, "map<string,string>")
    typed = F.from_json(column, "struct<" + ",".join(f"{n}:{t}" for n, t, _ in fields) + ">")
    strict = F.from_json(column, "struct<" + ",".join(f"{n}:{t}" for n, t, _ in fields) + ",_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    missing = F.filter(F.array(*[F.lit(n) for n, _, _ in fields]), lambda n: ~F.map_contains_key(raw, n))
    null = F.array_compact(F.array(*[F.when(typed[n].isNull(), F.lit(n)) for n, _, may in fields if not may]))
    fault = (
        F.when(raw.isNull(), "not a JSON object")
        .when(~raw["entityType"].eqNullSafe(F.lit(kind)), F.concat(F.lit("not a "), F.lit(kind)))
        .when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
        .when(strict["_bad"].isNotNull(), "a field has another type")
        .when(F.size(null) > 0, F.concat(F.lit("null in "), F.array_join(null, ", ")))
    )
    record = F.struct(*[typed[n].alias(_snake(n)) for n, _, _ in fields])
    return rows.withColumn("fault", fault).withColumn("record", F.when(F.col("fault").isNull(), record))


def write_json(kind: str) -> Column:
    """A record's JSON, discriminator first, nulls kept, e-mail addresses left out; columns are the table's."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.lit(kind).alias("entityType")]
    for name, type_, _ in _fields(kind):
        c = F.lit(None).cast("string") if name == "authorEmail" else F.col(_snake(name))
        parts.append((stamp(c) if type_ == "timestamp" else c).alias(name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def file_name(kind: Column, key: Column) -> Column:
    return F.concat(base64url(F.concat_ws(":", kind, key)), F.lit(".json"))


def requested(keys: DataFrame, artefacts: DataFrame) -> DataFrame:
    """keys (artefact) with file and json, null where the corpus lacks them: missing ones don't stop the rest."""
    return keys.select("artefact").distinct().join(artefacts, "artefact", "left")


def manifest(chunks: DataFrame) -> DataFrame:
    """(file, chunks): how many chunks each artefact must become."""
    return chunks.groupBy(file_name(F.col("entity_type"), F.col("entity_key")).alias("file")).agg(F.count("*").alias("chunks"))


def blob_of(message: Column, container: str = "artefacts-in") -> Column:
    """struct(blob, fault) of a queue message: JSON or base64 of it, one event or a list of one, a blob created in the container."""
    text = F.regexp_replace(F.trim(message), "^﻿", "")
    plain = F.when(text.rlike(r"^[\[{]"), text).otherwise(F.regexp_replace(F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8"), "^﻿", ""))
    event = "struct<eventType:string,subject:string>"
    several = F.from_json(plain, f"array<{event}>")
    one = F.when(plain.startswith("["), F.when(F.size(several) == 1, several[0])).otherwise(F.from_json(plain, event))
    prefix = SUBJECT.format(container=container)
    subject = one["subject"]
    good = subject.startswith(prefix) & (F.length(subject) > len(prefix))
    fault = F.when(one.isNull() | one["eventType"].isNull(), "not a single event").when(one["eventType"] != CREATED, "not a created blob").when(~F.coalesce(good, F.lit(False)), "not in the container")
    return F.struct(F.when(fault.isNull(), F.substr(subject, F.lit(len(prefix) + 1))).alias("blob"), fault.alias("fault"))
