"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

import struct

import xxhash

from . import mixing, outliers

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# Fixed values of the XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _times(a: str, k: int) -> str:
    return f"(({a})::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _rotl(a: str, n: int) -> str:
    return f"((({a}) % {1 << (64 - n)}::UBIGINT) * {1 << n}::UBIGINT + (({a}) >> {64 - n}))"


def _hash_steps(source: str, key: str, seed: str, out: str, prefix: str) -> str:
    """CTEs that add ``out``: XXH64 of the 8 bytes of a column under a seed, as an unsigned number.
    One step per CTE, so that no expression is written out twice."""
    return f"""
  {prefix}1 AS (SELECT *, {_times(f"({key})::UBIGINT", _P2)} AS h1 FROM {source}),
  {prefix}2 AS (SELECT * EXCLUDE (h1), {_times(_rotl("h1", 31), _P1)} AS h2 FROM {prefix}1),
  {prefix}3 AS (SELECT * EXCLUDE (h2), xor((({seed})::UHUGEINT + {(_P5 + 8) % (1 << 64)}::UHUGEINT) % 18446744073709551616::UHUGEINT, h2::UHUGEINT)::UBIGINT AS h3 FROM {prefix}2),
  {prefix}4 AS (SELECT * EXCLUDE (h3), (({_times(_rotl("h3", 27), _P1)})::UHUGEINT + {_P4}::UHUGEINT) % 18446744073709551616::UHUGEINT AS h4 FROM {prefix}3),
  {prefix}5 AS (SELECT * EXCLUDE (h4), {_times("xor(h4::UBIGINT, h4::UBIGINT >> 33)", _P2)} AS h5 FROM {prefix}4),
  {prefix}6 AS (SELECT * EXCLUDE (h5), {_times("xor(h5, h5 >> 29)", _P3)} AS h6 FROM {prefix}5),
  {prefix} AS (SELECT * EXCLUDE (h6), xor(h6, h6 >> 32) AS {out} FROM {prefix}6)"""


def _seed_of(number: int) -> int:
    """The seed that hashing a literal first leaves for the next column."""
    return xxhash.xxh64_intdigest(struct.pack("<q", number), seed=42)


def op1_sql(shards: int) -> str:
    """Sizes, checksums byte by byte, and the largest draw among the shards (equal weights: the
    smallest -ln(u) is the largest u)."""
    seeds = ", ".join(f"({s}, {_seed_of(s)}::UBIGINT)" for s in range(shards + 1))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS crc),
  sums AS (
    SELECT doc_id, octet_length(encode(text))::BIGINT + 8 AS size,
           xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
                           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
    FROM docs, bits),
  pairs AS (SELECT doc_id, shard, seed FROM docs, (VALUES {seeds}) s(shard, seed)),
  {_hash_steps("pairs", "doc_id", "seed", "draw", "d")},
  best AS (SELECT doc_id, arg_max(shard, (draw >> 11, -shard)) FILTER (WHERE shard < {shards}) AS shard, arg_max(shard, (draw >> 11, -shard)) AS grown_shard FROM d GROUP BY doc_id),
  {_hash_steps("best", "doc_id", "42", "place", "p")}
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY place, doc_id) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM p JOIN sums USING (doc_id)
"""


def _fill_sql(source: str, wanted: str, most: str, budget: str) -> str:
    """The factor c for which the sum of least(most, c * wanted) is the budget, infinite if all don't reach it: with
    the first i rows by most / wanted at their most, c is what's left over the rest, and i the first that fits."""
    order = f"OVER (ORDER BY {most} / {wanted} ROWS UNBOUNDED PRECEDING)"
    return f"""(SELECT coalesce(arg_min(c, i) FILTER (WHERE c < ratio), 'infinity'::DOUBLE) FROM (
      SELECT i, ratio, ({budget} - held + {most}) / (open_ + {wanted}) AS c FROM (
        SELECT {wanted}, {most}, {most} / {wanted} AS ratio, count(*) {order} AS i, sum({most}) {order} AS held,
               sum({wanted}) OVER () - sum({wanted}) {order} AS open_ FROM {source})))"""


def op2_sql() -> str:
    """The raking to a budget written out, one CTE per margin and round."""
    margins = ("source", "lang", "topic")
    goals = ""
    for m in margins:
        known = "cells WHERE topic <> 'none'" if m == "topic" else "cells"
        goals += f""",
  k_{m} AS MATERIALIZED (SELECT {m}, sum(n_tokens)::DOUBLE AS had, sum(n_tokens) * {mixing.RATE}::DOUBLE AS room, pow(sum(n_tokens) / (SELECT total FROM size), {mixing.POWER}::DOUBLE) AS wanted FROM {known} GROUP BY {m}),
  g_{m} AS MATERIALIZED (SELECT {m}, least(room, wanted * {_fill_sql(f"k_{m}", "wanted", "room", f"(SELECT budget * (SELECT sum(had) FROM k_{m}) / total FROM size)")}) AS goal FROM k_{m})"""
    steps, last = "", "w"
    for i in range(mixing.ROUNDS):
        for m in margins:
            steps += f""",
  w_{i}_{m} AS MATERIALIZED (SELECT c.* REPLACE (free * coalesce(goal / sum(least(free, most)) OVER (PARTITION BY c.{m}), 1.0) AS free) FROM {last} c LEFT JOIN g_{m} g ON g.{m} = c.{m})"""
            last = f"w_{i}_{m}"
    return f"""
WITH t AS (SELECT vec_id, 't' || min(label) AS topic FROM embeddings GROUP BY vec_id),
  docs AS (SELECT doc_id, source, lang, coalesce(topic, 'none') AS topic, greatest(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens
           FROM documents LEFT JOIN t ON vec_id = doc_id),
  cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n_tokens FROM docs GROUP BY ALL),
  size AS MATERIALIZED (SELECT sum(n_tokens)::DOUBLE AS total, {mixing.KEEP}::DOUBLE * sum(n_tokens) AS budget FROM cells){goals},
  w AS (SELECT *, (SELECT budget / total FROM size) * n_tokens AS free, {mixing.RATE}::DOUBLE * n_tokens AS most FROM cells){steps},
  scaled AS MATERIALIZED (SELECT *, least(most, free * {_fill_sql(last, "free", "most", "(SELECT budget FROM size)")}) AS weight FROM {last}),
  rates AS (SELECT source, lang, topic, weight, weight / n_tokens AS probability FROM scaled),
  {_hash_steps("docs", "doc_id", f"{_seed_of(mixing.SEED)}::UBIGINT", "draw", "d")}
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 3) AS cell_tokens, round(probability, 9) AS probability,
       ((draw >> 11)::DOUBLE + 0.5) / 9007199254740992.0 < probability AS sampled
FROM d JOIN rates r ON r.source = d.source AND r.lang = d.lang AND r.topic = d.topic
"""


OP3_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op4_sql(threshold: int, keep: str = "true") -> str:
    """``keep``: the documents that are in; a row is a document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE {keep}),
  lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
  keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{upper}', '{lower}') AS key FROM lines),
  hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {threshold}),
  marked AS (SELECT keyed.*, hot.key IS NOT NULL AS dropped FROM keyed LEFT JOIN hot ON hot.key = keyed.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _fit_sql(name: str, source: str, keys: str, scale: float = 1.0) -> str:
    """CTEs from rows to centre and Cholesky factor per group."""
    p, k, sq = range(len(outliers.STATS)), outliers.STATS, outliers.FLOOR * outliers.FLOOR
    sums = [f"avg({k[i]}) AS m_{i}" for i in p] + [f"covar_pop({k[i]}, {k[j]}) * {scale!r}::DOUBLE + {sq if i == j else 0.0!r}::DOUBLE AS v_{i}{j}" for i in p for j in range(i + 1)]
    return f""",
  {name}_v AS (SELECT {keys}, count(*) AS n, {', '.join(sums)} FROM {source} GROUP BY {keys}){_factor_sql(name, keys)}"""


def _factor_sql(name: str, keys: str) -> str:
    """The Cholesky factor, column after column; later columns read earlier ones by their aliases."""
    n, made = len(outliers.STATS), []
    for j in range(n):
        made.append(f"sqrt(greatest(v_{j}{j}" + "".join(f" - l_{j}{k} * l_{j}{k}" for k in range(j)) + f", 1e-12)) AS l_{j}{j}")
        made += [f"(v_{i}{j}" + "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j)) + f") / l_{j}{j} AS l_{i}{j}" for i in range(j + 1, n)]
    det = " + ".join(f"ln(l_{i}{i})" for i in range(n))
    return f""",
  {name} AS MATERIALIZED (SELECT {keys}, n, {', '.join(f"m_{i}" for i in range(n))}, {', '.join(made)}, {det} AS log_det FROM {name}_v)"""


def _distance_sql(row: str, fit: str) -> str:
    """Squared distance by forward substitution, as aliases y_i and then ``distance``."""
    y = [f"({row}.{s} - {fit}.m_{i}" + "".join(f" - {fit}.l_{i}{j} * y_{j}" for j in range(i)) + f") / {fit}.l_{i}{i} AS y_{i}" for i, s in enumerate(outliers.STATS)]
    return ", ".join(y) + ", " + " + ".join(f"y_{i} * y_{i}" for i in range(len(y))) + " AS distance"


def _same(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in keys.split(","))


def _mcd_sql(p: str, keys: str) -> str:
    """CTEs from ``sound`` to ``{p}best``: the estimate of each group of ``keys``, its concentration steps written out."""
    o, both = outliers, f"{keys}, start"
    n, bins = len(o.STATS), o.BINS
    quant = lambda q: f"min(CASE WHEN upto >= {q} * total THEN (bin + 0.5) / {bins} END)"
    sql = f""",
  {p}cells AS (SELECT {keys}, unnest(range({n})) AS stat, unnest([{', '.join(f'floor({s} * {bins})' for s in o.STATS)}]) AS bin FROM sound),
  {p}placed AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, stat ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}, stat) AS total FROM (SELECT {keys}, stat, bin, count(*) AS n FROM {p}cells GROUP BY ALL)),
  {p}spread AS (SELECT {keys}, stat, max(total) AS n, {quant(0.25)} AS q25, {quant(0.5)} AS q50, {quant(0.75)} AS q75 FROM {p}placed GROUP BY {keys}, stat),
  {p}med_v AS (SELECT {keys}, max(n) AS n, {', '.join(f"max(CASE WHEN stat = {i} THEN q50 END) AS m_{i}" for i in range(n))},
      {', '.join(f"max(CASE WHEN stat = {i} THEN ((q75 - q25) / 1.349::DOUBLE) * ((q75 - q25) / 1.349::DOUBLE) + {o.FLOOR * o.FLOOR}::DOUBLE END) AS v_{i}{i}" for i in range(n))},
      {', '.join(f"0.0::DOUBLE AS v_{i}{j}" for i in range(n) for j in range(i))} FROM {p}spread GROUP BY {keys}){_factor_sql(f'{p}med', keys)}{_fit_sql(f'{p}cla', 'sound', keys)},
  {p}fit_0 AS MATERIALIZED (SELECT *, 0 AS start FROM {p}med UNION ALL BY NAME SELECT *, 1 AS start FROM {p}cla)"""
    for step in range(o.STEPS):
        sql += f""",
  {p}near_{step} AS MATERIALIZED (SELECT r.*, f.start, {_distance_sql('r', 'f')}, floor(ln(distance + 1e-9) * {bins}) AS bin FROM sound r JOIN {p}fit_{step} f ON {_same('r', 'f', keys)}),
  {p}hist_{step} AS (SELECT *, sum(n) OVER (PARTITION BY {both} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {both}) AS total FROM (SELECT {both}, bin, count(*) AS n FROM {p}near_{step} GROUP BY ALL)),
  {p}edge_{step} AS (SELECT {both}, min(CASE WHEN upto >= {o.SHARE} * total THEN bin END) AS edge FROM {p}hist_{step} GROUP BY {both}),
  {p}core_{step} AS (SELECT r.* FROM {p}near_{step} r JOIN {p}edge_{step} e ON {_same('r', 'e', both)} WHERE bin <= edge){_fit_sql(f'{p}fit_{step + 1}', f'{p}core_{step}', both, o.CONSISTENCY if step == o.STEPS - 1 else 1.0)}"""
    return sql + f""",
  {p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY log_det, start) AS nth FROM {p}fit_{o.STEPS}) WHERE nth = 1 AND n >= {o.SHARE * o.LEAST})"""


def op9_sql() -> str:
    """The counts, the estimates of the groups, of the languages and of all rows, and each row's distance by
    the first of them that there is."""
    o = outliers
    levels = {"g_": "lang, source", "l_": "lang", "a_": "every"}
    ys = ", ".join(f"y_{i}" for i in range(len(o.STATS)))
    measured, source, far = "", "rows", "distance"
    for p, keys in levels.items():
        kept = "r.*" if far == "distance" else "r.* EXCLUDE (far), r.far AS before"
        measured += f""",
  {p}judged AS (SELECT * EXCLUDE ({ys}, distance{'' if far == 'distance' else ', before'}), {far} AS far FROM (SELECT {kept}, {_distance_sql('r', 'f')} FROM {source} r LEFT JOIN {p}best f ON {_same('r', 'f', keys)}))"""
        source, far = f"{p}judged", "coalesce(before, distance)"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  g AS (SELECT doc_id, i, array_to_string(words[i:i + {o.WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {o.WINDOW - 2})) AS i FROM w)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1),
  cover AS (SELECT doc_id, sum(least({o.WINDOW}, coalesce(after - i, {o.WINDOW}))) AS covered FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
  counted AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      len(list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACE}) <> ''))::BIGINT - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACE}) <> '')))::BIGINT AS n_dup_lines FROM w),
  rows AS MATERIALIZED (SELECT c.*, 0 AS every, coalesce(covered, 0)::BIGINT AS n_repeat_words,
      n_words < {o.MIN_WORDS} OR 100 * coalesce(covered, 0) > {o.MAX_REPEAT_PERCENT} * n_words AS base_failed,
      ln(greatest(n_words, 1)) AS s1, ln(greatest(word_chars, 1) / greatest(n_words, 1)) AS s2, ln(1 + 10 * n_symbols / greatest(n_words, 1)) AS s3,
      ln(1 + 10 * n_dup_lines / greatest(n_words, 1)) AS s4, coalesce(covered, 0) / greatest(n_words, 1) AS s5
      FROM counted c LEFT JOIN cover ON cover.doc_id = c.doc_id),
  sound AS MATERIALIZED (SELECT lang, source, every, {', '.join(o.STATS)} FROM rows WHERE NOT base_failed){''.join(_mcd_sql(p, keys) for p, keys in levels.items())}{measured}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(far <= {o.CUTOFF}, true) AS kept, CASE WHEN NOT base_failed THEN round(far, 4) END AS distance FROM a_judged
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_sql(width: int) -> str:
    """Every window of a text written out and joined with the items' windows, as strings."""
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
  sized AS (SELECT item, w, least(len(w), {width}) AS n FROM items WHERE len(w) > 0),
  starts AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM sized),
  windows AS (SELECT DISTINCT item, n, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM starts),
  lengths AS (SELECT DISTINCT n FROM windows),
  docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
  places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, lengths WHERE len(w) >= n),
  met AS (SELECT r, n, pos, item FROM (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM places) JOIN windows USING (n, win)),
  hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT r, n, pos FROM met)) GROUP BY r),
  own AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


def op12_sql(least_docs: int, smooth: int, best: int) -> str:
    """Counts of all kept terms in all groups, with zeros, and both comparisons of their shares."""
    share = f"1 + (1000000000::HUGEINT * (n + {smooth})) // (total + {smooth} * v)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
  kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
  sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  seen AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
  cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)),
  totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
  p AS (SELECT lang, source, term, n, ({share})::BIGINT AS p FROM cells JOIN totals USING (lang, source) JOIN sizes USING (lang)),
  lang_cells AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
  lang_totals AS (SELECT lang, sum(n) AS total FROM lang_cells GROUP BY ALL),
  q AS (SELECT lang, term, ({share})::BIGINT AS q FROM lang_cells JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
  apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
  more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {best}
"""
