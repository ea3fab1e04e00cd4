"""DuckDB SQL of the operators that SQL can express on whole tables, column for column."""

from __future__ import annotations

from feedloom.llm import chat_format, embedding_dedup, hard_negatives, line_dedup, ngram_join, secret_scan, source_mix


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_spans() -> str:
    """Per rule the matches of a text and what stands between them; running sums of lengths give positions."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {'true' if r.base else 'false'} AS base, {r.least} AS least, regexp_extract_all(body, {_text(r.pattern)}, 0) AS hits, regexp_extract_all(body, {_text(r.pattern)}, {r.group}) AS vals, string_split_regex(body, {_text(r.pattern)}) AS gaps FROM d"
        for i, r in enumerate(secret_scan.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), m AS ({found}),
        h AS (SELECT doc_id, rank, kind, base, least, i, hits[i] AS hit, vals[i] AS val, CAST(list_sum([length(g) for g in gaps[:i]]) + coalesce(list_sum([length(x) for x in hits[:i - 1]]), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
        s AS (SELECT *, kind || ':' || start || ':' || (start + length(hit)) AS span FROM h WHERE length(val) >= least),
        a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY 1)
        SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


#: Components by the smallest vertex that each vertex reaches.
_REACH = "r AS (SELECT id, id AS other FROM v UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT id, min(other) AS component_id FROM r GROUP BY 1)"


def ngram_components(width: int = ngram_join.WIDTH, percent: int = ngram_join.PERCENT) -> str:
    """Sets of shingles; documents with equal sets stand for one another in the join on shared shingles."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        v AS (SELECT id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(words[i:i + {width - 1}], ' ') for i in range(1, greatest(len(words) - {width - 1}, 1) + 1)])) END AS grams FROM w),
        k AS (SELECT min(id) AS id, grams, len(grams) AS n FROM v WHERE len(grams) > 0 GROUP BY grams),
        g AS (SELECT id, n, unnest(grams) AS gram FROM k),
        p AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.id <> y.id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent} GROUP BY 1, 2 HAVING count(*) * 100 >= (any_value(x.n) + any_value(y.n) - count(*)) * {percent}),
        same AS (SELECT v.id, k.id AS lead FROM v JOIN k ON v.grams = k.grams),
        e AS (SELECT a, b FROM p UNION SELECT id, lead FROM same UNION SELECT lead, id FROM same), {_REACH}
        SELECT v.id AS doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id FROM v JOIN c ON c.id = v.id"""


def embedding_components(threshold: float = embedding_dedup.THRESHOLD) -> str:
    """All pairs of one label by cosine in double precision."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        u AS (SELECT id, label, x, sqrt(list_sum([y * y for y in x])) AS norm FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len([y for y in x if y IS NULL OR NOT isfinite(y)]) = 0),
        e AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND len(p.x) = len(q.x) AND p.id <> q.id WHERE p.norm > 0 AND q.norm > 0 AND list_inner_product(p.x, q.x) / (p.norm * q.norm) >= {threshold}),
        n AS (SELECT a, count(*) AS n FROM e GROUP BY 1), {_REACH}
        SELECT v.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN c ON c.id = v.id LEFT JOIN n ON n.a = v.id"""


def deduplicated_lines() -> str:
    """Lines by first place; near ones meet by what is left when a unit is deleted: a word of long lines, a character of short ones."""
    near, chars = line_dedup.NEAR_WORDS, line_dedup.NEAR_CHARS
    return f"""WITH d AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM documents),
        l AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)),
        k AS (SELECT array_to_string(words, ' ') AS body, words, min({{'doc': doc_id, 'i': i}}) AS place FROM l WHERE len(words) > 0 GROUP BY words),
        t AS (SELECT body, place, 'w' AS unit, words AS units, len(words) AS n FROM k UNION ALL SELECT body, place, 'c', string_split(body, ''), length(body) FROM k WHERE len(words) < {near}),
        x AS (SELECT *, unnest(range(1, n + 1)) AS spot FROM t),
        o AS (SELECT body, place, unit, n, spot, CASE unit WHEN 'w' THEN array_to_string(units[:spot - 1] || units[spot + 1:], ' ') ELSE array_to_string(units[:spot - 1] || units[spot + 1:], '') END AS rest FROM x WHERE n >= CASE unit WHEN 'w' THEN {near} ELSE {chars} END),
        whole AS (SELECT body, place, unit, n, body AS rest FROM t WHERE n + 1 >= CASE unit WHEN 'w' THEN {near} ELSE {chars} END),
        p AS (SELECT a.body, b.place FROM o a JOIN o b ON a.unit = b.unit AND a.n = b.n AND a.spot = b.spot AND a.rest = b.rest WHERE b.place < a.place
          UNION ALL SELECT a.body, b.place FROM o a JOIN whole b ON a.unit = b.unit AND a.n = b.n + 1 AND a.rest = b.rest WHERE b.place < a.place
          UNION ALL SELECT b.body, a.place FROM o a JOIN whole b ON a.unit = b.unit AND a.n = b.n + 1 AND a.rest = b.rest WHERE a.place < b.place),
        nearest AS (SELECT body, min(place).doc AS doc FROM p GROUP BY 1),
        s AS (SELECT l.doc_id, l.i, l.line, CASE WHEN nearest.doc IS NOT NULL THEN nearest.doc WHEN {{'doc': l.doc_id, 'i': l.i}} > k.place THEN k.place.doc END AS first FROM l LEFT JOIN k ON k.words = l.words LEFT JOIN nearest ON nearest.body = k.body),
        g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL), '') AS cleaned, count(first) AS n_removed, list_sort(list_distinct(list(first) FILTER (first IS NOT NULL))) AS firsts FROM s GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN CASE WHEN n_removed > 0 THEN cleaned ELSE d.text END END AS text, CAST(n_lines AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(array_to_string(firsts, ','), '') AS first_docs FROM d LEFT JOIN g USING (doc_id)"""


def mixed_sources() -> str:
    """Shares by largest remainder, one period scheduled slot by slot, positions from the counts before a slot. Ids are unique."""
    period, rows = source_mix.PERIOD, source_mix.BLOCK_ROWS
    return f"""WITH RECURSIVE c AS (SELECT coalesce('=' || source, '-') AS s, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
        x AS (SELECT *, greatest({period}, 10 * count(*) OVER ()) AS p, w / sum(w) OVER () * greatest({period}, 10 * count(*) OVER ()) AS exact FROM c),
        f AS (SELECT *, greatest(1, floor(exact)::BIGINT) AS low, row_number() OVER (ORDER BY floor(exact) - exact, s) AS turn FROM x),
        g AS (SELECT *, low + CASE WHEN turn <= p - sum(low) OVER () THEN 1 ELSE 0 END AS share FROM f),
        h AS (SELECT s, n, p, CASE WHEN row_number() OVER (ORDER BY share DESC, s) = 1 THEN share - greatest(0, sum(share) OVER () - p) ELSE share END::BIGINT AS share FROM g),
        par AS (SELECT list(share ORDER BY s) AS a, list(n ORDER BY s) AS n, sum(share)::BIGINT AS p, list(s ORDER BY s) AS names FROM h),
        sched AS (SELECT -1::BIGINT AS slot, [0::BIGINT for z in a] AS done, [0::BIGINT for z in a] AS before, 0::BIGINT AS pick FROM par
          UNION ALL SELECT slot + 1, [done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END for i in range(1, len(done) + 1)], done, pick FROM (SELECT slot, done,
            list_sort([{{'d': ((done[i] + 1) * p + a[i] - 1) // a[i], 'i': i}} for i in range(1, len(a) + 1) if done[i] < a[i] AND done[i] * p // a[i] <= slot + 1])[1].i AS pick FROM sched, par WHERE slot + 1 < p)),
        t AS (SELECT slot, pick, before, before[pick] AS turn FROM sched WHERE slot >= 0),
        d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS s, row_number() OVER (PARTITION BY source ORDER BY sha256('=' || doc_id)) - 1 AS rank FROM documents),
        b AS (SELECT d.*, list_position(names, s) AS pick, a, n, p, rank // {rows} AS block FROM d, par),
        e AS (SELECT *, block // a[pick] AS cycle, block % a[pick] AS turn FROM b)
        SELECT doc_id, source, rank AS mix_source_rank, block AS mix_block, cycle * p + slot AS mix_slot, CAST(list_sum([least((cycle * a[j] + before[j]) * {rows}, n[j]) for j in range(1, len(a) + 1)]) + rank % {rows} AS BIGINT) AS mix_position FROM e JOIN t USING (pick, turn)"""


def mined_negatives(low: int = hard_negatives.LOW, high: int = hard_negatives.HIGH, k: int = hard_negatives.K) -> str:
    """Every anchor against every row; sums of whole numbers are exact in double precision."""
    return f"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({hard_negatives.SCALE} * CAST(y AS DOUBLE)) for y in embedding] AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.x) = len(b.x)),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {k})
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= {high} * score AND score <= positive_score QUALIFY rank <= {k}"""


def formatted_chats() -> str:
    """Turns in order; control strings have no overlap, so each is broken by a replacement of its own."""
    escaped = "replace({}, chr(92), chr(92) || chr(92))"
    for c in chat_format.TEMPLATE.controls:
        escaped = f"replace({escaped}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    marks = len(chat_format.TEMPLATE.begin + chat_format.TEMPLATE.middle + chat_format.TEMPLATE.end)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({marks} + length({escaped.format('role')}) + length({escaped.format('text')})) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""


ORACLES = {
    "op1_secret_scan": secret_spans(),
    "op4_ngram_join": ngram_components(),
    "op5_embedding_dedup": embedding_components(),
    "op7_source_mix": mixed_sources(),
    "op10_line_dedup": deduplicated_lines(),
    "op11_hard_negatives": mined_negatives(),
    "op13_chat_format": formatted_chats(),
}
