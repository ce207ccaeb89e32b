"""The mixing query in DuckDB's SQL, written out from the same definitions."""

from __future__ import annotations

from .mixing import Mix


def _quotas(x: str, parties: str, by: str) -> str:
    """CTEs that give ``{x}q``: ``parties`` (``w``, ``cap``, ``pos``, ``units``, ``by``) with ``quota``."""
    group = f"PARTITION BY {by}" if by else ""
    before = f"({group} ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def mine(total: str) -> str:
        return f"CASE WHEN w > 0 THEN ({total} - coalesce(sum(cap) OVER {before}, 0)) / (sum(w) OVER ({group}) - coalesce(sum(w) OVER {before}, 0)) END"

    def units(level: str) -> str:
        return f"CAST(CASE WHEN w <= 0 THEN 0 WHEN {level} IS NULL THEN cap ELSE least(cap, floor(w * {level} + 0.5)) END AS BIGINT)"

    same = f"b.{by} IS NOT DISTINCT FROM a.{by} AND " if by else ""
    ranked = f"PARTITION BY {by} " if by else ""
    return f"""
{x}1 AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END AS ratio,
  least(units, sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({group})) AS tot, count(*) OVER ({group}) AS m FROM {parties}),
{x}2 AS (SELECT *, {mine("greatest(tot - m, 0)")} AS mine_low, {mine("(tot + m)")} AS mine_high FROM {x}1),
{x}3 AS (SELECT *, max(CASE WHEN mine_low <= ratio THEN mine_low END) OVER ({group}) AS low, max(CASE WHEN mine_high <= ratio THEN mine_high END) OVER ({group}) AS high FROM {x}2),
{x}4 AS (SELECT *, {units("low")} AS base, {units("high")} AS top FROM {x}3),
{x}5 AS (SELECT *, tot - sum(base) OVER ({group}) AS rest_units FROM {x}4),
{x}6 AS (SELECT *, unnest(generate_series(base + 1, top)) AS k FROM {x}5),
{x}7 AS (SELECT *, row_number() OVER ({ranked}ORDER BY w / (2 * k - 1) DESC, pos, k) AS place FROM {x}6),
{x}8 AS (SELECT {by + ', ' if by else ''}pos, count(*) AS won FROM {x}7 WHERE place <= rest_units GROUP BY ALL),
{x}q AS (SELECT a.*, base + coalesce(won, 0) AS quota FROM {x}5 a LEFT JOIN {x}8 b ON {same}b.pos = a.pos)"""


def oracle(mix: Mix = Mix()) -> str:
    def md5(kind: str, key: str) -> str:
        return f"CAST('0x' || substr(md5('{mix.seed}/{kind}/' || {key}), 1, 15) AS BIGINT)"

    doc = "coalesce(CAST(doc_id AS VARCHAR), '')"
    block = mix.block_words

    def picked(k: str) -> str:
        return f"(floor(({k} + start) * rest / blocks) - floor(start * rest / blocks))"

    def before(x: str) -> str:
        j = f"floor({x} / {block})"
        return f"least(rest_words, {picked(j)} * {block} + ({picked(f'({j} + 1)')} - {picked(j)}) * ({x} - {j} * {block}))"

    weights = ", ".join(f"{w!r}" for w in mix.weights)
    early = "(ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s1 AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sizes GROUP BY source),
s2 AS (SELECT *, CAST([{weights}][(pos - 1) % {len(mix.weights)} + 1] AS DOUBLE) AS w, CAST(source_size * {mix.max_repeats} AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * {mix.share!r} AS total FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER {early}, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER {early}, 0)) AS mine FROM s3),
s5 AS (SELECT *, max(CASE WHEN mine <= ratio THEN mine END) OVER () AS level FROM s4),
targets AS (SELECT source, source_size, w AS weight, pos AS source_pos, least(cap, coalesce(w * level, cap)) AS target, CAST(greatest(1, ceil(n_docs / {mix.docs_per_shard})) AS BIGINT) AS shards FROM s5),
units AS (SELECT CAST(greatest(1, least({block}, floor(min(target) FILTER (source_size > 0) / {mix.least_blocks}))) AS BIGINT) AS unit FROM targets),
dealt AS (SELECT doc_id, t.*, size, {md5('shard', doc)} % shards AS shard FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
by_shard AS (SELECT source, shard, target, weight, source_pos, unit, CAST(sum(size) AS BIGINT) AS shard_size, CAST(sum(size) * {mix.max_repeats} // unit AS BIGINT) AS cap FROM dealt, units GROUP BY source, shard, target, weight, source_pos, unit),
per_source AS (SELECT source, weight AS w, unit, CAST(sum(cap) AS BIGINT) AS cap, source_pos AS pos, max(target) AS target FROM by_shard GROUP BY source, weight, unit, source_pos),
parties AS (SELECT *, CAST(round(sum(target) OVER () / unit) AS BIGINT) AS units FROM per_source),
{_quotas('a', 'parties', '')},
members AS (SELECT b.source, b.shard, CAST(b.shard_size AS DOUBLE) AS w, b.cap, b.shard AS pos, quota AS units, b.shard_size, b.unit
  FROM by_shard b JOIN aq ON b.source IS NOT DISTINCT FROM aq.source),
{_quotas('c', 'members', 'source')},
dealt_out AS (SELECT source, shard, CAST(ceil(shard_size / {block}) AS BIGINT) AS blocks, CASE WHEN shard_size > 0 THEN quota * unit // shard_size ELSE 0 END AS passes,
  CASE WHEN shard_size > 0 THEN quota * unit % shard_size ELSE 0 END AS rest_words, ({block} - shard_size % {block}) % {block} AS short,
  ({md5('start', "(coalesce(source, '') || '/' || CAST(shard AS VARCHAR))")} % 1000003) / CAST(1000003 AS DOUBLE) AS start FROM cq),
got AS (SELECT *, CASE WHEN rest_words > 0 THEN least(blocks, CAST(ceil((rest_words + short) / {block}) AS BIGINT)) ELSE 0 END AS rest FROM dealt_out),
laid AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY {md5('order', doc)}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS line_start FROM dealt)
SELECT doc_id, l.source, size, source_size, target,
  CAST(passes * size + CASE WHEN rest > 0 AND size > 0 THEN {before('(line_start + size)')} - {before('line_start')} ELSE 0 END AS BIGINT) AS taken
FROM laid l JOIN got g ON l.source IS NOT DISTINCT FROM g.source AND l.shard = g.shard
"""
