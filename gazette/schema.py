"""Schemas of stored tables, closed vocabularies, and who owns which column."""

from __future__ import annotations

SCHEMA_VERSION = 1

PROVENANCE = "struct<source_name:string,source_representation:string,adapter_type:string,parser_version:int,extraction_method:string,identity_basis:string,identity_key:string,discovered_at:timestamp,source_role:string,selector:string,run_id:string>"
REVISION = "struct<revision:int,date:date,changed_fields:array<string>,summary:string,content_hash:string,title_snapshot:string,summary_snapshot:string,run_id:string>"
ARTIFACT = "struct<status:string,path:string,generated_at:date,generated_from_revision:int,model:string,prompt_version:int>"

#: Columns of a stored object, in the order in which they are written (fixed by the format).
OBJECT_COLUMNS = {
    "schema_version": "int", "id": "string", "slug": "string", "title": "string", "source_name": "string", "source_url": "string",
    "announcement_url": "string", "identity_confidence": "string", "source_authority": "string", "published_date": "date",
    "discovered_date": "date", "date_confidence": "string", "date_precision": "string", "content_hash": "string",
    "provenance": PROVENANCE, "url_hash": "string", "tier": "int", "learning_priority": "string", "category": "string",
    "tags": "array<string>", "difficulty": "string", "workload": "string", "version": "string", "reading_time": "int",
    "learning_status": "string", "notes": "string", "prerequisites": "array<string>", "builds_on": "array<string>",
    "related_topics": "array<string>", "replaced_by": "string", "replaces": "string", "lifecycle": "string", "status": "string",
    "needs_review": "boolean", "overrides": "array<string>", "revisions": f"array<{REVISION}>", "generation": f"map<string,{ARTIFACT}>",
}
OBJECTS = ", ".join(f"`{k}` {v}" for k, v in OBJECT_COLUMNS.items())

#: Columns that a person writes, and those that rules propose and a person may lock; all others are the engine's (fixed values).
USER_OWNED = ("learning_status", "notes", "prerequisites", "builds_on", "related_topics", "replaced_by", "replaces", "overrides")
PROPOSED = ("tier", "learning_priority", "category", "tags", "difficulty", "workload", "version")

#: Closed vocabularies (fixed values).
VOCABULARIES = {
    "date_confidence": ("exact", "inferred"),
    "date_precision": ("day", "month", "year"),
    "source_authority": ("official", "community", "third-party"),
    "identity_confidence": ("high", "medium", "low"),
    "lifecycle": ("discovered", "queued", "approved", "minted", "archived"),
    "status": ("active", "replaced", "deprecated"),
}

#: Items as sources give them, before they have an identifier.
ITEM_COLUMNS = ("source_name", "source_url", "announcement_url", "source_authority", "title", "summary", "published_date", "date_confidence", "date_precision", "raw_tags", "identity", "extraction_method", "selector")
