"""Functions for SQL: scalar ones on text and trees, and a table function for elements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import align, text, tree


#: Functions that are SQL expressions, which the optimiser puts in place: name and parameters, result, expression.
INLINED = [
    ("doc_structural(t STRING)", "STRING", r"regexp_replace(regexp_replace(t, r'[ \t]*[\r\n]+[ \t]*', ''), r'\t', '')"),
    ("doc_stripped(t STRING)", "STRING", f"regexp_replace(t, r'{text.UNICODE_SPACE}+', '')"),
    ("doc_nonspace(t STRING)", "INT", "length(doc_stripped(t))"),
    ("doc_id_valid(v STRING)", "BOOLEAN", f"coalesce(v RLIKE r'{text.ID_PATTERN}', false)"),
    ("doc_escaped(t STRING)", "STRING", """replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&#39;')"""),
    ("doc_paragraph(t STRING)", "STRING", "concat('<p>', replace(doc_escaped(t), char(10), '<br/>'), '</p>')"),
    ("doc_sha256(t STRING)", "STRING", "sha2(encode(t, 'UTF-8'), 256)"),
    ("doc_safe_link(u STRING)", "BOOLEAN", r"coalesce(u RLIKE r'(?i)^https?://[^/?#@\s]+(?:[/?#]\S*)?$', false)"),
    ("doc_fence(t STRING)", "STRING", "repeat('`', greatest(3, coalesce(array_max(transform(regexp_extract_all(t, '`+', 0), x -> length(x))), 0) + 1))"),
    ("doc_output_budget(prompt BIGINT)", "BIGINT", "least(8192, 16384 - 512 - prompt)"),
    ("doc_backoff(failures INT)", "BIGINT", "CAST(least(30, power(2, failures)) AS BIGINT)"),
]


def register_inlined(spark: SparkSession) -> None:
    """The functions of ``INLINED`` for a session. Plans that use them have no Python in them."""
    for signature, result, body in INLINED:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")


def register(spark: SparkSession) -> None:
    """``doc_valid``, ``doc_plain_text``, ``doc_casefold``, ``doc_similarity`` and ``doc_nodes``, and those that are SQL expressions."""
    register_inlined(spark)

    @F.pandas_udf("boolean")
    def valid(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: not tree.validate(x))

    @F.pandas_udf("string")
    def plain(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: tree.plain_text(n) if (n := tree.block_of(x)) is not None else None)

    @F.pandas_udf("string")
    def casefold(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None else align.retrieval_text(v))

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(align.similarities([(x or "", y or "") for x, y in zip(a, b, strict=True)]), dtype=float)

    for name, f in (("doc_valid", valid), ("doc_plain_text", plain), ("doc_casefold", casefold), ("doc_similarity", similarity)):
        spark.udf.register(name, f)

    @F.udtf(returnType="node_ord int, parent_ord int, depth int, block_ord int, tag string, text string")
    class Nodes:
        def eval(self, xml: str):
            for n in tree.node_rows(xml):
                yield n[0], n[1], n[2], n[3], n[4], n[6]

    spark.udtf.register("doc_nodes", Nodes)
