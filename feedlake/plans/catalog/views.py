"""SQL text of the standard views, for the DuckDB oracles (mirrors ``sources.tables``)."""

FEEDBACK = """(select d.doc_id as row_id, d.text, cast(1 + e.user_id % 5 as int) as level, e.ts, d.lang, d.source
   from documents d left join events e on e.event_id = 10 * d.doc_id)"""

RATED_ORDERS = """(select o_orderkey as row_id, try_cast(substr(o_orderpriority, 1, 1) as int) as level,
   o_orderdate as ts from orders)"""

VECTORS = """(select vec_id as row_id, cast(embedding as double[]) as embedding, label as level from embeddings)"""


def norm_sql(x: str) -> str:
    """DuckDB form of the text normalisation (lower, collapse spaces, drop punctuation)."""
    return (
        "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(" + x + ", '')), "
        r"'\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
    )


def hash_sql(x: str) -> str:
    return f"substr(sha256({norm_sql(x)}), 1, 16)"


# Python's str.isspace() set, for the blank test
NON_SPACE_SQL = r"'[^\s\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"
