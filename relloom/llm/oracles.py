"""DuckDB SQL for the results that SQL can express by a plainer path."""

from __future__ import annotations

from relloom.llm import quality as Q

#: All pairs that share a shingle, counted on full sets, then the smallest id reachable.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM texts, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT sides.b, reach.root FROM reach JOIN sides ON reach.doc_id = sides.a WHERE reach.root < sides.b),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

#: Every window of every item against every window of every text.
CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM docs, lengths, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
found AS (SELECT doc_id, k, i, item_id FROM places JOIN windows USING (k, s)),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM found, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def quality_sql() -> str:
    """The base counts by plain grouping, and the same estimate step by step."""
    dims = Q.DIMS
    pairs = [(x, y) for i, x in enumerate(dims) for y in dims[i:]]

    def factors(source: str) -> str:
        """A chain of selects that adds d_x and l_y_x to rows with c_x_y."""
        sql = source
        for j, x in enumerate(dims):
            d = f"c_{x}_{x} * {Q.CONSISTENT} + {Q.FLOOR[j] ** 2!r}"
            for k in dims[:j]:
                d += f" - l_{x}_{k} * l_{x}_{k} * d_{k}"
            sql = f"(SELECT *, {d} AS d_{x} FROM {sql})"
            for y in dims[j + 1 :]:
                v = f"c_{x}_{y} * {Q.CONSISTENT}"
                for k in dims[:j]:
                    v += f" - l_{y}_{k} * l_{x}_{k} * d_{k}"
                sql = f"(SELECT *, ({v}) / d_{x} AS l_{y}_{x} FROM {sql})"
        return sql

    def distance(rows: str) -> str:
        sql = rows
        for j, x in enumerate(dims):
            v = f"{x} - m_{x}" + "".join(f" - l_{x}_{k} * y_{k}" for k in dims[:j])
            sql = f"(SELECT *, {v} AS y_{x} FROM {sql})"
        return f"(SELECT *, {' + '.join(f'y_{x} * y_{x} / d_{x}' for x in dims)} AS dist FROM {sql})"

    medians = ", ".join(
        f"(SELECT min(cell) FROM (SELECT cell, sum(count(*)) OVER (ORDER BY cell) AS upto FROM (SELECT floor({x} * "
        f"{Q.MEDIAN_CLASSES}) AS cell FROM kept_rows r WHERE r.g = s.g) GROUP BY cell) WHERE upto * 2 >= s.size)"
        f" AS cell_{x}" for x in dims
    )
    zero = ", ".join(f"0.0::DOUBLE AS c_{x}_{y}" for x, y in pairs)
    centre = ", ".join(f"(cell_{x} + 0.5) / {Q.MEDIAN_CLASSES} AS m_{x}" for x in dims)
    steps = [
        f"""groups AS (SELECT g, lg, count(*) FILTER (NOT base_failed) AS n FROM vectors GROUP BY g, lg),
langs AS (SELECT lg, sum(n) AS n_lang, min(n) AS least FROM groups GROUP BY lg),
placed AS (
  SELECT *, CASE WHEN n >= {Q.LEAST} THEN g WHEN n_lang >= {Q.LEAST} THEN lg ELSE 'all' END AS used FROM groups JOIN langs USING (lg)),
pools AS MATERIALIZED (
  SELECT g, used, list_filter([
    CASE WHEN n >= {Q.LEAST} THEN g END,
    CASE WHEN least < {Q.LEAST} AND n_lang >= {Q.LEAST} THEN lg END,
    CASE WHEN (SELECT bool_or(used = 'all') FROM placed) THEN 'all' END], lambda x: x IS NOT NULL) AS pools FROM placed),
kept_rows AS MATERIALIZED (
  SELECT unnest(pools) AS g, len, symbols, lines, repeats FROM vectors JOIN pools USING (g) WHERE NOT base_failed)""",
        "sized AS (SELECT g, count(*) AS size FROM kept_rows GROUP BY g)",
        f"middle AS (SELECT g, size, {medians} FROM sized s)",
        f"e0 AS MATERIALIZED (SELECT * FROM {factors(f'(SELECT g, {centre}, {zero} FROM middle)')})",
    ]
    for k in range(Q.STEPS):
        sums = ", ".join(
            [f"sum({x}) / count(*) AS m_{x}" for x in dims]
            + [f"sum({x} * {y}) / count(*) - (sum({x}) / count(*)) * (sum({y}) / count(*)) AS c_{x}_{y}" for x, y in pairs]
        )
        placed = distance(f"(SELECT kept_rows.*, e{k}.* EXCLUDE (g) FROM kept_rows JOIN e{k} USING (g))")
        steps += [
            f"p{k} AS MATERIALIZED (SELECT *, floor(ln(dist + 1e-9) * {Q.CLASSES}) AS cell FROM {placed})",
            f"u{k} AS (SELECT g, cell, sum(count(*)) OVER (PARTITION BY g ORDER BY cell) AS upto,"
            f" sum(count(*)) OVER (PARTITION BY g) AS size FROM p{k} GROUP BY g, cell)",
            f"x{k} AS (SELECT g, min(cell) AS edge FROM u{k} WHERE upto >= size * {Q.SHARE} GROUP BY g)",
            f"s{k} AS (SELECT g, {sums} FROM p{k} JOIN x{k} USING (g) WHERE cell <= edge GROUP BY g)",
            f"e{k + 1} AS MATERIALIZED (SELECT * FROM {factors(f's{k}')})",
        ]
    last = f"e{Q.STEPS}"
    judged = distance(
        f"(SELECT v.*, {last}.* EXCLUDE (g) FROM (SELECT * FROM vectors JOIN pools USING (g)) v LEFT JOIN {last} ON v.used = {last}.g)"
    )
    return (
        r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM texts, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT j) AS n FROM twice, LATERAL (SELECT unnest(range(i, i + 5)) AS j) GROUP BY rid),
lined AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
counted AS (
  SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM texts JOIN lined USING (rid) LEFT JOIN covered USING (rid)),
vectors AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce('=' || lang, '-') || chr(31) || coalesce('=' || source, '-') AS g, 'L' || coalesce('=' || lang, '-') AS lg,
    ln((word_chars + 500.0::DOUBLE) / (n_words + 100.0::DOUBLE)) AS len,
    asin(sqrt(least(1.0::DOUBLE, n_symbols / (word_chars + 500.0::DOUBLE)))) AS symbols,
    asin(sqrt(least(1.0::DOUBLE, n_dup_lines / (n_lines + 10.0::DOUBLE)))) AS lines,
    asin(sqrt(least(1.0::DOUBLE, n_repeat_words / (n_words + 100.0::DOUBLE)))) AS repeats
  FROM counted),
"""
        + ",\n".join(steps)
        + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(dist <= {Q.CUTOFF}, true) AS kept
FROM {judged}
"""
    )


QUALITY_SQL = quality_sql()
