"""Queries of the document operators over the driver tables.

Conversations stand for documents: a turn is a block, its text in a paragraph its XML, its role
the image that it comes from. Pages are untrusted markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tree
from ..operators import blocks as B
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col


def turns(t: Tables) -> DataFrame:
    """Conversations as blocks."""
    paragraph = F.concat(F.lit("<p>"), T.escaped(col("text")), F.lit("</p>"))
    status = F.when(F.trim("text") == "", "unresolved").otherwise("ok")
    return t.conversations.select(
        col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), col("role").alias("image_id"), "text", paragraph.alias("xml"), status.alias("status"), F.lit(0).alias("version")
    )


@query("SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, trim(text) <> '' AS valid FROM conversations")
def dm4_valid_turns(t: Tables) -> DataFrame:
    """A turn in a paragraph is a valid block unless it is blank."""
    rows = turns(t).withColumn("wrapped", F.concat(F.lit(tree.envelope("\0").partition("\0")[0]), "xml", F.lit("</update>")))
    return B.validated(rows, "wrapped").select("document_id", "ord", "check.valid")


@query("SELECT 'p' AS tag, count(*) AS n FROM conversations WHERE trim(text) <> '' UNION ALL SELECT 'update', count(*) FROM conversations WHERE trim(text) <> ''")
def ag3_tags(t: Tables) -> DataFrame:
    """Elements by name."""
    rows = turns(t).withColumn("wrapped", F.concat(F.lit(tree.envelope("\0").partition("\0")[0]), "xml", F.lit("</update>")))
    return B.tag_histogram(B.nodes(rows, ["document_id", "ord"], "wrapped"))


@query("SELECT conv_id::VARCHAR AS document_id, '<document xmlns=\"urn:docflow:document:1\" schema-version=\"0.1\">' || string_agg('<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</p>', '' ORDER BY turn) || '</document>' AS xml, CASE WHEN bool_and(trim(text) = '') THEN 'unavailable' WHEN bool_or(trim(text) = '') THEN 'partial' ELSE 'complete' END AS xml_status FROM conversations GROUP BY 1")
def sk8_documents(t: Tables) -> DataFrame:
    """Blocks in order in their envelope."""
    return B.documents(turns(t))
