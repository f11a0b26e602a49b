"""The chunks of texts in SQL: pieces level by level, then one recursive step a chunk."""

from __future__ import annotations

# Chunk size, overlap, the cuts from coarse to fine, and what is trimmed off a chunk.
SIZE, OVERLAP = 800, 100
CUTS = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
_BLANKS = " || ".join(f"chr({c})" for c in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def _level(n: int, cut: str) -> str:
    return f"""
l{n} AS (
  SELECT source, flatten(list_transform(ps, lambda p: CASE WHEN length(p.x) < {SIZE} THEN [{{'x': p.x, 'f': p.f}}]
    ELSE list_transform(range(1, len(p.parts) + 1), lambda i: {{'x': p.parts[i],
      'f': i = 1 OR length(p.parts[i]) >= {SIZE} OR length(p.parts[i - 1]) >= {SIZE}}}) END)) AS ps
  FROM (SELECT source, list_transform(ps, lambda p: {{'x': p.x, 'f': p.f, 'parts': list_filter(
      list_transform(string_split(p.x, {cut}), lambda s, i: CASE WHEN i = 1 THEN s ELSE {cut} || s END),
      lambda s: s <> '')}}) AS ps FROM l{n - 1}) q{n})"""


def _wide(i: str, lo: str) -> str:
    return f"(fs[{i}] OR cs[{i}] - (cs[{lo}] - ns[{lo}]) > {SIZE})"


def chunk_ctes(docs: str, name: str = "chunks") -> str:
    """CTEs that end in ``name`` (source, chunk, chunk_id, text), over the CTE ``docs`` (source, text).

    They belong behind WITH RECURSIVE. Pieces lo to hi - 1 are a chunk.
    """
    levels = ",".join(_level(n, cut) for n, cut in enumerate(CUTS, 1))
    return f"""l0 AS (SELECT source, [{{'x': text, 'f': true}}] AS ps FROM {docs} WHERE text <> ''),{levels},
pieces AS (
  SELECT source, i, ps[i].x AS x, ps[i].f AS f, length(ps[i].x) AS n
  FROM (SELECT source, ps, unnest(range(1, len(ps) + 1)) AS i FROM l{len(CUTS)}) u),
lists AS MATERIALIZED (
  SELECT source, list(x ORDER BY i) AS xs, list(n ORDER BY i) AS ns, list(f ORDER BY i) AS fs, list(c ORDER BY i) AS cs,
         CAST(max(i) AS BIGINT) AS m
  FROM (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY i) AS c FROM pieces) s GROUP BY source),
walk AS (
  SELECT source, CAST(1 AS BIGINT) AS lo,
         coalesce(list_min(list_filter(range(2, m + 1), lambda i: {_wide('i', '1')})), m + 1) AS hi FROM lists
  UNION ALL
  SELECT source, lo, coalesce(list_min(list_filter(range(was + 1, m + 1), lambda i: {_wide('i', 'lo')})), m + 1)
  FROM (
    SELECT w.source, w.hi AS was, ns, fs, cs, m, CASE WHEN fs[w.hi] THEN w.hi ELSE list_min(list_filter(
        range(w.lo, w.hi + 1), lambda j: (cs[w.hi] - ns[w.hi]) - (cs[j] - ns[j]) <= {OVERLAP}
          AND (j = w.hi OR cs[w.hi] - (cs[j] - ns[j]) <= {SIZE}))) END AS lo
    FROM walk w JOIN lists l ON l.source = w.source WHERE w.hi <= m) n),
cut AS (
  SELECT w.source, lo, hi, trim(array_to_string(xs[lo:hi - 1], ''), {_BLANKS}) AS text
  FROM walk w JOIN lists l ON l.source = w.source),
{name} AS MATERIALIZED (
  SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY lo, hi) - 1 AS INTEGER) AS chunk,
         regexp_replace(regexp_extract(source, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') || '_'
           || (row_number() OVER (PARTITION BY source ORDER BY lo, hi) - 1) AS chunk_id, text
  FROM cut WHERE text <> '')"""
