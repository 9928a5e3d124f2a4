"""Types of the tables and of spans inside texts, and the status order of keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,`end`:int,class:string>"
SPANS = f"array<{SPAN}>"
DOCUMENT = "id long, object_type string, system_id string, root_id long, is_active boolean, created_at timestamp, updated_at timestamp, text string, ner_text string"
KEYWORD = "id long, value string, type string, updated_at timestamp"
LINK = "document_id long, keyword_id long, status string, meta struct<indices:array<array<int>>>, created_at timestamp, updated_at timestamp"

EXTRACTED, CONFIRMED, REJECTED, ADDED = "extracted", "confirmed", "rejected", "added"

# Which status wins when spans overlap.
PRIORITY = {CONFIRMED: 4, REJECTED: 3, ADDED: 2, EXTRACTED: 1}


def priority(status: Column) -> Column:
    """4 for confirmed, 3 rejected, 2 added, 1 extracted, 0 for anything else and null."""
    out = F.lit(0)
    for name, n in PRIORITY.items():
        out = F.when(status == name, n).otherwise(out)
    return out
