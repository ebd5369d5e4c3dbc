"""The registry of queries, and the views that stand in for parsed documents.

A query pairs a Spark plan with DuckDB SQL that must give the same rows. ``BLOCKS`` and ``GLYPHS``
are SQL twins of ``blocks`` and ``glyphs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan, and its SQL if SQL can say it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def blocks_of(docs: DataFrame) -> DataFrame:
    """Typed blocks of documents: a line is a block, ten blocks a page; boxes follow from the block's place.

    doc_id, n, page_num, block_id, block_type, content, x0, y0, x1, y1.
    """
    lines = docs.where("text is not null").selectExpr("doc_id", "posexplode(split(text, '\\n')) as (n, content)")
    return lines.selectExpr(
        "doc_id",
        "n",
        "n div 10 as page_num",
        "concat('p', n div 10, '_b', n % 10) as block_id",
        """case when trim(content) = '' then 'image' when contains(content, '|') then 'table'
                when length(content) <= 60 then 'heading'
                when content rlike '[=^_\\\\\\\\]|[0-9][0-9][0-9]' then 'formula' else 'paragraph' end as block_type""",
        "content",
        "cast((n * 37) % 300 as double) as x0",
        "cast((n % 10) * 70 as double) as y0",
        "cast((n * 37) % 300 + 200 + length(content) % 50 as double) as x1",
        "cast((n % 10) * 70 + 10 + length(content) div 60 as double) as y1",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(table(spark, sf_dir, "documents"))


BLOCKS = r"""
lines as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents where text is not null),
blocks as (
  select doc_id, n::int as n, (n // 10)::bigint as page_num, 'p' || (n // 10) || '_b' || (n % 10) as block_id,
         case when trim(content) = '' then 'image' when contains(content, '|') then 'table'
              when length(content) <= 60 then 'heading'
              when regexp_matches(content, '[=^_\\]|[0-9][0-9][0-9]') then 'formula' else 'paragraph' end as block_type,
         content, ((n * 37) % 300)::double as x0, ((n % 10) * 70)::double as y0,
         ((n * 37) % 300 + 200 + length(content) % 50)::double as x1, ((n % 10) * 70 + 10 + length(content) // 60)::double as y1
  from lines)
"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs on pages: an order is a page, a line item a glyph; boxes, fonts and characters follow from keys."""
    items = table(spark, sf_dir, "lineitem").withColumn("i", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"))
    return items.selectExpr(
        "l_orderkey as page_num",
        "i as idx",
        "concat('g', l_orderkey, '_', i) as node_id",
        "cast(i * 12 + l_partkey % 5 as double) as x0",
        "cast(100 + l_suppkey % 9 as double) as y0",
        "cast(i * 12 + l_partkey % 5 + 4 + l_partkey % 7 as double) as x1",
        "cast(100 + l_suppkey % 9 + 6 + l_suppkey % 4 as double) as y1",
        "cast(8 + l_suppkey % 4 as double) as size",
        "concat(case when l_partkey % 3 = 0 then 'ABCDEF+' else '' end, element_at(array('CMR10', 'CMMI10', 'Times', 'Symbol'), cast(l_partkey % 4 + 1 as int))) as font",
        "cast(l_partkey % 50 as int) as cid",
        "case when l_partkey % 11 = 0 then '' when l_partkey % 13 = 0 then concat('cid:', l_partkey % 50) when l_partkey % 29 = 0 then '\ufffd' else substring('abcxyz=+-123', cast(l_partkey % 12 + 1 as int), 1) end as text",
    )


GLYPHS = """
glyphs as (
  select l_orderkey as page_num, i::int as idx, 'g' || l_orderkey || '_' || i as node_id,
         (i * 12 + l_partkey % 5)::double as x0, (100 + l_suppkey % 9)::double as y0,
         (i * 12 + l_partkey % 5 + 4 + l_partkey % 7)::double as x1, (100 + l_suppkey % 9 + 6 + l_suppkey % 4)::double as y1,
         (8 + l_suppkey % 4)::double as size,
         case when l_partkey % 3 = 0 then 'ABCDEF+' else '' end || ['CMR10', 'CMMI10', 'Times', 'Symbol'][(l_partkey % 4 + 1)::int] as font,
         (l_partkey % 50)::int as cid,
         case when l_partkey % 11 = 0 then '' when l_partkey % 13 = 0 then 'cid:' || (l_partkey % 50) when l_partkey % 29 = 0 then '\ufffd' else substr('abcxyz=+-123', (l_partkey % 12 + 1)::int, 1) end as text
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i from lineitem))
"""


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula candidates: a part is one, with LaTeX, stage and scores that follow from its key; three in a row make a group."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as result_id",
        "p_partkey div 3 as candidate_id",
        """element_at(array(
             concat('\\\\frac{', p_size, '}{x_', p_partkey % 7, '} + \\\\alpha'),
             concat('\\\\mathbf{A}^{', p_size, '} = \\\\sum_{i=', p_partkey % 5, '} b_i'),
             concat('$x_', p_partkey % 9, ' − ', p_size, '$'),
             concat('\\\\sqrt{', p_size, '} \\\\left( y + \\\\text{rate} \\\\right)'),
             concat('\\\\begin{pmatrix} a & ', p_size, ' \\\\end{pmatrix}'),
             concat(' f( x ) = g * ( y_', p_partkey % 3, ' + ', p_size, ' )')), cast(p_partkey % 6 + 1 as int)) as latex""",
        "element_at(array('parsed_blocks', 'pdf_structure', 'local_precise', 'cloud_semantic', 'inline_spans'), cast(p_partkey % 5 + 1 as int)) as stage",
        "(p_partkey * 7 % 101) / 100.0D as similarity",
        "(p_partkey * 13 % 97) / 96.0D as score",
        "element_at(array('', 'low_confidence', 'table_like', 'empty_result', 'minor'), cast((p_partkey div 3) % 5 + 1 as int)) as warning",
        "cast(p_partkey % 17 as int) as page_num",
        "cast((p_partkey div 8) * 31 % 400 + p_partkey % 8 div 4 as double) as x0",
        "cast((p_partkey div 8) * 17 % 600 + p_partkey % 2 as double) as y0",
        "cast((p_partkey div 8) * 31 % 400 + 60 as double) as x1",
        "cast((p_partkey div 8) * 17 % 600 + 20 + p_partkey % 3 as double) as y1",
    )


FORMULAS = r"""
formulas as (
  select p_partkey as result_id, (p_partkey // 3)::bigint as candidate_id,
    [ '\frac{' || p_size || '}{x_' || (p_partkey % 7) || '} + \alpha',
      '\mathbf{A}^{' || p_size || '} = \sum_{i=' || (p_partkey % 5) || '} b_i',
      '$x_' || (p_partkey % 9) || ' − ' || p_size || '$',
      '\sqrt{' || p_size || '} \left( y + \text{rate} \right)',
      '\begin{pmatrix} a & ' || p_size || ' \end{pmatrix}',
      ' f( x ) = g * ( y_' || (p_partkey % 3) || ' + ' || p_size || ' )' ][(p_partkey % 6 + 1)::int] as latex,
    ['parsed_blocks', 'pdf_structure', 'local_precise', 'cloud_semantic', 'inline_spans'][(p_partkey % 5 + 1)::int] as stage,
    (p_partkey * 7 % 101)::double / 100.0::double as similarity, (p_partkey * 13 % 97)::double / 96.0::double as score,
    ['', 'low_confidence', 'table_like', 'empty_result', 'minor'][((p_partkey // 3) % 5 + 1)::int] as warning,
    (p_partkey % 17)::int as page_num,
    ((p_partkey // 8) * 31 % 400 + (p_partkey % 8) // 4)::double as x0, ((p_partkey // 8) * 17 % 600 + p_partkey % 2)::double as y0,
    ((p_partkey // 8) * 31 % 400 + 60)::double as x1, ((p_partkey // 8) * 17 % 600 + 20 + p_partkey % 3)::double as y1
  from part)
"""
