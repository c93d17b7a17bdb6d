"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

from .functions.bits import MAG2SEL
from .functions.codecs import BLOCK_CODECS
from .operators.retrieval import QUERIES

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_P = f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), p AS (SELECT term, doc_id, count(*)::BIGINT AS freq FROM t GROUP BY ALL), l AS (SELECT doc_id, len({_TOKENS})::BIGINT AS doc_len FROM documents), c AS (SELECT count(*)::BIGINT AS num_docs, sum(doc_len)::BIGINT AS num_tokens, sum(doc_len)::DOUBLE / count(*) AS avg_len FROM l), lex AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id FROM (SELECT DISTINCT term FROM t))"
_VALUES = ", ".join(f"({k}::BIGINT, '{q}')" for k, q in enumerate(QUERIES))
_Q = f"{_P}, queries(query_id, text) AS (VALUES {_VALUES}), qs AS (SELECT query_id, [x FOR x IN string_split(lower(text), ' ') IF x <> ''] AS ts FROM queries), qt AS (SELECT query_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM qs), q AS (SELECT query_id, token AS term, count(*)::BIGINT AS qtf FROM qt GROUP BY ALL), need AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1)"
_W = f"{_Q}, w AS (SELECT term, p.doc_id, freq, num_docs, freq / (freq + 1.2::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * (doc_len / avg_len))) AS d_w FROM p JOIN l USING (doc_id), c), st AS (SELECT term, count(*)::BIGINT AS df, sum(freq)::BIGINT AS cf, max(d_w) AS max_term_weight FROM w GROUP BY 1), s AS (SELECT query_id, doc_id, sum(floor(qtf * greatest(1e-6::DOUBLE, ln((num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * 2.2::DOUBLE * d_w * 1e12::DOUBLE + 0.5::DOUBLE)::BIGINT) AS units, count(*) AS found FROM q JOIN w USING (term) JOIN st USING (term) GROUP BY ALL)"
_TOP = "SELECT query_id, rank, doc_id, round(units::DOUBLE / 1e12::DOUBLE, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM s {where}) WHERE rank <= 10"
_HITS = f"{_Q}, h AS (SELECT query_id, doc_id, count(*) AS found, sum(freq) AS freq FROM q JOIN p USING (term) GROUP BY ALL), r AS (SELECT query_id, count(*) AS results, sum(freq) AS freq_sum FROM h {{where}} GROUP BY 1) SELECT query_id, coalesce(results, 0)::BIGINT AS results {{freq}} FROM queries LEFT JOIN r USING (query_id)"
_EVERY, _FREQ = "JOIN need USING (query_id) WHERE found = terms", ", coalesce(freq_sum, 0)::BIGINT AS freq_sum"

_LISTS = "WITH u AS (SELECT max(l_orderkey) + 1 AS num_docs FROM lineitem), a AS (SELECT l_suppkey AS term_id, l_orderkey AS doc_id, count(*)::BIGINT AS freq FROM lineitem GROUP BY ALL), p AS (SELECT a.*, num_docs, (row_number() OVER w - 1)::BIGINT AS position, lag(doc_id, 1, -1) OVER w AS before, doc_id - lag(doc_id, 1, -1) OVER w - 1 AS gap, (count(*) OVER (PARTITION BY term_id))::BIGINT AS size FROM a, u WINDOW w AS (PARTITION BY term_id ORDER BY doc_id))"


def _floor_log2(x: str) -> str:
    return f"(length(bin({x})) - 1)"


def _ceil_log2(x: str) -> str:
    return f"(CASE WHEN {x} > 1 THEN length(bin({x} - 1)) ELSE 0 END)"


def _gamma(x: str) -> str:
    return f"(2 * {_floor_log2(f'({x} + 1)')} + 1)"


def _delta(x: str) -> str:
    low = _floor_log2(f"({x} + 1)")
    return f"({_gamma(low)} + {low})"


def _vbyte(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END)"


def _ef(u: str, n: str, zeros: int = 9) -> str:
    low = f"(CASE WHEN {u} > {n} THEN {_floor_log2(f'(({u}) // ({n}))')} ELSE 0 END)"
    high = f"({n} + (({u}) // (1::BIGINT << {low}::INT)) + 2)"
    skip = "0" if zeros == 63 else f"(({high} - ({n})) // 512) * {_ceil_log2(high)}"
    return f"({skip} + (({n}) // 256) * {_ceil_log2(high)} + {high} + ({n}) * {low})"


def _strict_ef(u: str, n: str, zeros: int = 9) -> str:
    return _ef(f"({u} - {n} + 1)", n, zeros)


def _bitmap(u: str, n: str, ranks: int = 9) -> str:
    skip = "0" if ranks == 63 else f"(({u}) // 512) * {_ceil_log2(f'({n} + 1)')}"
    return f"({skip} + (({n}) // 256) * {_ceil_log2(f'({u})')} + ({u}))"


def _cheapest(u: str, n: str, ef: str, bitmap: str) -> tuple[str, str]:
    kind = f"CASE WHEN {u} = {n} THEN 'all_ones' WHEN {ef} <= {bitmap} THEN 'elias_fano' ELSE 'bitmap' END"
    return kind, f"(CASE WHEN {u} = {n} THEN 0 ELSE least({ef}, {bitmap}) + 1 END)::BIGINT"


_OVERHEAD = "(CASE WHEN block_no = 0 THEN 4 ELSE 8 END)"


def _blocks(size: int) -> str:
    return f"{_LISTS}, b AS (SELECT term_id, position // {size} AS block_no, max(size) AS list_size, count(*)::BIGINT AS n, min(before) + 1 AS block_base, max(doc_id) AS block_max, list(gap ORDER BY position) AS gaps, list(freq - 1 ORDER BY position) AS freqs, sum({_vbyte('gap')})::BIGINT AS vbyte_doc_bytes, sum({_vbyte('(freq - 1)')})::BIGINT AS vbyte_freq_bytes, 4 * count(*)::BIGINT AS u32_bytes FROM p GROUP BY ALL)"


def _class_stats(size: int) -> str:
    kind = f"CASE WHEN list_size < {size} THEN 'small' WHEN n = {size} THEN 'full' ELSE 'last' END"
    return f'{_blocks(size)} SELECT {kind} AS "class", count(*)::BIGINT AS blocks, sum(n)::BIGINT AS postings, sum({_OVERHEAD})::BIGINT AS overhead_bytes, sum(vbyte_doc_bytes)::BIGINT AS vbyte_doc_bytes, sum(vbyte_freq_bytes)::BIGINT AS vbyte_freq_bytes, sum(u32_bytes)::BIGINT AS u32_bytes FROM b GROUP BY 1'


def _sel(x: str) -> str:
    return f"({MAG2SEL})[{_ceil_log2(x)} + 1]::BIGINT"


_N, _U, _O = "n", "universe", "occurrences"
_SIZES = f"{_LISTS}, z AS (SELECT term_id, count(*)::BIGINT AS n, sum(freq)::BIGINT AS occurrences, max(num_docs) AS universe, max(doc_id) AS last, min(doc_id) AS first FROM p GROUP BY 1)"
_KIND, _COST = _cheapest(_U, _N, _ef(_U, _N), _bitmap(_U, _N))
_FKIND, _FCOST = _cheapest(f"({_O} + 1)", _N, _strict_ef(f"({_O} + 1)", _N, 63), _bitmap(f"({_O} + 1)", _N, 63))
_HEADER = f"({_gamma('(occurrences - 1)')} + CASE WHEN occurrences > 1 THEN {_ceil_log2('(occurrences + 1)')} ELSE 0 END)::BIGINT"
_PU = "(last - base + 1)"
_PKIND, _PCOST = _cheapest(_PU, _N, _ef(_PU, _N), _bitmap(_PU, _N))
_PARTS = f"{_LISTS}, g AS (SELECT term_id, position // 128 AS part, count(*)::BIGINT AS n, max(size) AS size, max(num_docs) AS universe, CASE WHEN min(position) = 0 THEN min(doc_id) ELSE min(before) + 1 END AS base, max(doc_id) AS last FROM p GROUP BY 1, 2), e AS (SELECT *, {_PKIND} AS type, {_PCOST} AS bits FROM g)"
_STREAMS = f"{_blocks(256)}, v AS (SELECT 'doc' AS stream, term_id, block_no, n, gaps AS vals FROM b UNION ALL SELECT 'freq', term_id, block_no, n, freqs FROM b), o AS (SELECT *, list_sort(vals) AS s FROM v), k AS (SELECT *, {_sel('(s[n] + 1)')} AS top, {_sel('(s[1] + 1)')} AS low, {_sel('(s[n // 2 + 1] + 1)')} AS mid, {_sel('(s[9 * n // 10 + 1] + 1)')} AS p90, s[n] <> 0 AS has FROM o), x AS (SELECT stream, term_id, block_no, n, vals, top AS \"max\", 16 * top + low AS minmax, CASE WHEN 16 * p90 + mid = 0 AND has THEN 1 ELSE 16 * p90 + mid END AS med90p, CASE WHEN 16 * top + mid = 0 AND has THEN 1 ELSE 16 * top + mid END AS medmax FROM k)"


def _symbol(x: str) -> str:
    return f"(CASE WHEN {x} <= 256 THEN {x} WHEN {x} <= 65536 THEN {x} // 256 + 256 WHEN {x} <= 16777216 THEN {x} // 65536 + 512 ELSE {x} // 16777216 + 768 END)"


_HIST = f"{_STREAMS}, y AS (SELECT stream, medmax AS model_id, unnest(vals) + 1 AS x FROM x WHERE stream = 'freq' OR n > 10), h AS (SELECT stream, model_id, {_symbol('x')} AS symbol, count(*)::BIGINT AS count FROM y GROUP BY ALL)"
_NUMBERS = "WITH d AS (SELECT DISTINCT unnest([l_orderkey, l_partkey, trunc(l_extendedprice * 100)::BIGINT, trunc(l_extendedprice * 10000)::BIGINT]) AS x FROM lineitem), n AS (SELECT x FROM d WHERE x >= 0)"
_PROBES = " UNION ALL ".join(f"SELECT term_id, num_docs * {i} // 8 AS probe, coalesce(min(doc_id) FILTER (doc_id >= num_docs * {i} // 8), num_docs) AS doc_id, count(*) FILTER (doc_id < num_docs * {i} // 8) AS position FROM p GROUP BY term_id, num_docs" for i in range(9))


def _constant(label: str, name: str, size: int, streams: tuple[str, ...]) -> str:
    return f"{_blocks(size)} " + " UNION ALL ".join(f"SELECT '{name}' AS {label}, '{s}' AS stream, count(*)::BIGINT AS blocks, sum(n)::BIGINT AS postings, 0::BIGINT AS mismatches FROM b" for s in streams)


def oracle_sql() -> dict[str, str]:
    out = {
        "postings": f"{_P} SELECT * FROM p",
        "lexicon": f"{_P} SELECT term_id, term FROM lex",
        "collection_stats": f"{_P} SELECT num_docs, num_tokens, round(avg_len, 9) AS avg_len FROM c",
        "doc_stats": f"{_P} SELECT doc_id, doc_len, round(doc_len / avg_len, 9) AS norm_len FROM l, c",
        "term_stats": f"{_W} SELECT term, df, cf, round(max_term_weight, 9) AS max_term_weight FROM st",
        "verify_postings": f"{_P} SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, count(*)::BIGINT AS postings, sum(freq * (doc_id + 1) * length(term))::BIGINT AS checksum FROM p",
        "query_tokens": f"{_Q} SELECT query_id, pos, token FROM qt",
        "query_terms": f"{_Q} SELECT * FROM q",
        "query_map": f"{_Q} SELECT query_id, pos, term_id FROM qt JOIN lex ON token = term WHERE query_id NOT IN (SELECT query_id FROM qt LEFT JOIN lex ON token = term WHERE term_id IS NULL)",
        "query_lines": f"{_Q} SELECT query_id, string_agg(term_id::VARCHAR, chr(9) ORDER BY pos) AS line FROM qt JOIN lex ON token = term WHERE query_id NOT IN (SELECT query_id FROM qt LEFT JOIN lex ON token = term WHERE term_id IS NULL) GROUP BY 1",
        "query_skipped": f"{_Q}, m AS (SELECT query_id, bool_and(term_id IS NOT NULL) AS ok FROM qt LEFT JOIN lex ON token = term GROUP BY 1) SELECT count(*)::BIGINT AS asked, count(*) FILTER (ok)::BIGINT AS mapped, count(*) FILTER (NOT ok)::BIGINT AS skipped FROM m",
        "bm25_weights": f"{_W} SELECT query_id, term, qtf, df, round(qtf * greatest(1e-6::DOUBLE, ln((num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * 2.2::DOUBLE, 9) AS weight FROM q JOIN st USING (term), c",
        "and_count": _HITS.format(where=_EVERY, freq=""),
        "and_freq": _HITS.format(where=_EVERY, freq=_FREQ),
        "or_count": _HITS.format(where="", freq=""),
        "or_freq": _HITS.format(where="", freq=_FREQ),
        "ranked_or": f"{_W} {_TOP.format(where='')}",
        "ranked_and": f"{_W} {_TOP.format(where=_EVERY)}",
        "list_view": f"{_SIZES} SELECT term_id, n, first, last, occurrences FROM z",
        "cursor_accessors": f"{_LISTS} SELECT term_id, doc_id, freq, position, size FROM p",
        "next_posting": f"{_LISTS} SELECT term_id, doc_id, lead(doc_id, 1, num_docs) OVER (PARTITION BY term_id ORDER BY doc_id) AS next_doc_id FROM p",
        "next_geq": f"{_LISTS} {_PROBES}",
        "move_to": f"{_LISTS} SELECT term_id, position, doc_id, freq, size FROM p WHERE position IN (0, size // 2, size - 1)",
        "prev_value": f"{_LISTS} SELECT term_id, doc_id, lag(doc_id, 1, 0) OVER (PARTITION BY term_id ORDER BY doc_id) AS prev_value FROM p",
        "freq_prefix_sum": f"{_LISTS} SELECT term_id, position, (sum(freq) OVER (PARTITION BY term_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS value FROM p",
        "positive_decode": f"{_LISTS} SELECT term_id, position, freq AS value FROM p",
        "block_layout": f"{_blocks(128)} SELECT term_id, block_no, n, block_base, block_max, {_OVERHEAD}::BIGINT AS overhead_bytes FROM b",
        "block_bytes": f"{_blocks(128)} SELECT term_id, block_no, list_size, n, vbyte_doc_bytes, vbyte_freq_bytes, u32_bytes FROM b",
        "block_size_stats": _class_stats(128),
        "index_size_stats": f"{_blocks(128)} SELECT sum(vbyte_doc_bytes)::BIGINT AS docs_size, sum(vbyte_freq_bytes)::BIGINT AS freqs_size, sum(CASE WHEN block_no = 0 THEN 4 + {_vbyte('list_size')} ELSE 8 END)::BIGINT AS meta_size, sum(n)::BIGINT AS postings, round(8 * sum(vbyte_doc_bytes)::DOUBLE / sum(n), 9) AS bits_per_doc, round(8 * sum(vbyte_freq_bytes)::DOUBLE / sum(n), 9) AS bits_per_freq FROM b",
        "stats_line": f"""SELECT '{{"type":"' || "class" || '","blocks":' || blocks || ',"postings":' || postings || ',"overhead_bytes":' || overhead_bytes || ',"vbyte_doc_bytes":' || vbyte_doc_bytes || ',"vbyte_freq_bytes":' || vbyte_freq_bytes || '}}' AS line FROM ({_class_stats(128)})""",
        "sequence_sizes": f"{_SIZES} SELECT term_id, n, universe, {_ef(_U, _N)}::BIGINT AS ef_bits, {_strict_ef(_U, _N)}::BIGINT AS strict_ef_bits, {_bitmap(_U, _N)}::BIGINT AS bitmap_bits, CASE WHEN universe = n THEN 0 END::BIGINT AS all_ones_bits, {_KIND} AS indexed_type, {_COST} AS indexed_bits, {_FKIND} AS freq_type, {_FCOST} AS freq_bits, {_HEADER} AS header_bits FROM z",
        "uniform_partitions": f"{_PARTS} SELECT term_id, part, n, size, universe, base, last, type, bits FROM e",
        "uniform_partition_size": f"{_PARTS}, f AS (SELECT term_id, count(*)::BIGINT AS k, sum(bits)::BIGINT AS body, max(size) AS n, max(universe) AS u, max(last) AS last, min(base) AS base FROM e GROUP BY 1) SELECT term_id, k AS partitions, (CASE WHEN k = 1 THEN {_gamma('(k - 1)')} + {_ceil_log2('u')} + (CASE WHEN n > 1 THEN (CASE WHEN last + 1 = u THEN 1 ELSE {_delta('(last - base)')} END) ELSE 0 END) + body ELSE {_gamma('(k - 1)')} + {_gamma(_ceil_log2('(body + 1)'))} + {_ef('u', '(k + 1)')} + (k - 1) * {_ceil_log2('(body + 1)')} + body END)::BIGINT AS bits FROM f",
        "endpoints": f"{_SIZES} SELECT term_id, (sum({_COST} + {_FCOST} + {_HEADER}) OVER (ORDER BY term_id ROWS UNBOUNDED PRECEDING))::BIGINT AS endpoint FROM z",
        "code_sizes": f"{_NUMBERS} SELECT x, {_ceil_log2('x')}::BIGINT AS log2, {_gamma('x')}::BIGINT AS gamma, {_delta('x')}::BIGINT AS delta, {_vbyte('x')}::BIGINT AS vbyte, (CASE WHEN x > 0 THEN (length(bin(x)) + 6) // 7 ELSE 1 END)::BIGINT AS vbyte64 FROM n",
        "symbols": f"{_NUMBERS} SELECT x, {_ceil_log2('x')}::BIGINT AS mag, {_sel('x')} AS sel, {_symbol('x')} AS symbol, (CASE WHEN x <= 256 THEN 0 WHEN x <= 65536 THEN 1 WHEN x <= 16777216 THEN 2 ELSE 3 END)::BIGINT AS exception_bytes FROM n WHERE x > 0",
        "contexts": f'{_STREAMS} SELECT stream, term_id, block_no, n, "max", minmax, med90p, medmax FROM x',
        "ans_histogram": f"{_HIST} SELECT * FROM h",
        "packed_histogram": f'{_STREAMS}, y AS (SELECT stream, "max" AS model_id, unnest(vals) + 1 AS x FROM x) SELECT stream, model_id, {_ceil_log2("x")}::BIGINT AS mag, count(*)::BIGINT AS count, max(x) AS max_value FROM y GROUP BY ALL',
        "ans_entropy": f"{_HIST}, m AS (SELECT *, (sum(count) OVER (PARTITION BY stream, model_id))::BIGINT AS total FROM h) SELECT stream, model_id, total, round(sum(count * log2(total / count)), 4) AS entropy FROM m GROUP BY ALL",
        "latency_quantiles": "WITH v AS (SELECT value::DOUBLE AS value FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n, round(avg(value), 6) AS avg FROM v), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS row FROM v) SELECT avg, max(value) FILTER (row = n * 50 // 100) AS q50, max(value) FILTER (row = n * 90 // 100) AS q90, max(value) FILTER (row = n * 95 // 100) AS q95 FROM r, n GROUP BY avg",
    }
    out["wand"] = out["maxscore"] = out["ranked_or"]
    out |= {f"verify_{c}": _constant("codec", c, 128, ("doc", "freq")) for c in BLOCK_CODECS}
    plain = f"({_O} + 1)"
    out["list_bits_ef"] = f"{_SIZES} SELECT term_id, n, ({_HEADER} + {_ef(_U, _N)})::BIGINT AS docs_bits, {_strict_ef(plain, _N)}::BIGINT AS freqs_bits, 0::BIGINT AS mismatches FROM z"
    out["list_bits_single"] = f"{_SIZES} SELECT term_id, n, ({_HEADER} + {_COST})::BIGINT AS docs_bits, {_FCOST} AS freqs_bits, 0::BIGINT AS mismatches FROM z"
    sums = "c AS (SELECT term_id, position, size, sum(freq) OVER w AS upto, sum(freq) OVER w - freq AS before FROM p WINDOW w AS (PARTITION BY term_id ORDER BY position ROWS UNBOUNDED PRECEDING))"
    fkind, fcost = _cheapest(_PU, _N, _strict_ef(_PU, _N, 63), _bitmap(_PU, _N, 63))
    fparts = f"fg AS (SELECT term_id, position // 128 AS part, count(*)::BIGINT AS n, max(size) AS size, CASE WHEN min(position) = 0 THEN min(upto) ELSE min(before) + 1 END AS base, max(upto) AS last FROM c GROUP BY 1, 2), fe AS (SELECT *, {fcost} AS bits FROM fg), ff AS (SELECT term_id, count(*)::BIGINT AS k, sum(bits)::BIGINT AS body, max(size) AS n, max(last) + 1 AS u, max(last) AS last, min(base) AS base FROM fe GROUP BY 1)"
    whole = f"(CASE WHEN k = 1 THEN {_gamma('(k - 1)')} + {_ceil_log2('u')} + (CASE WHEN n > 1 THEN (CASE WHEN last + 1 = u THEN 1 ELSE {_delta('(last - base)')} END) ELSE 0 END) + body ELSE {_gamma('(k - 1)')} + {_gamma(_ceil_log2('(body + 1)'))} + {_ef('u', '(k + 1)')} + (k - 1) * {_ceil_log2('(body + 1)')} + body END)::BIGINT"
    head = _HEADER.replace("occurrences", "(ff.u - 1)")
    out["list_bits_uniform"] = f"{_PARTS}, f AS (SELECT term_id, count(*)::BIGINT AS k, sum(bits)::BIGINT AS body, max(size) AS n, max(universe) AS u, max(last) AS last, min(base) AS base FROM e GROUP BY 1), db AS (SELECT term_id, {whole} AS bits FROM f), {sums}, {fparts}, fb AS (SELECT term_id, {whole} AS bits FROM ff) SELECT ff.term_id, ff.n, (db.bits + {head})::BIGINT AS docs_bits, fb.bits AS freqs_bits, 0::BIGINT AS mismatches FROM ff JOIN db USING (term_id) JOIN fb USING (term_id)"
    for c, doc, freq in (("vbyte", "vbyte_doc_bytes", "vbyte_freq_bytes"), ("u32", "u32_bytes", "u32_bytes")):
        out[f"verify_{c}"] = f"{_blocks(128)} " + " UNION ALL ".join(f"SELECT '{c}' AS codec, '{s}' AS stream, count(*)::BIGINT AS blocks, sum(n)::BIGINT AS postings, sum({x})::BIGINT AS bytes, 0::BIGINT AS mismatches FROM b" for s, x in (("doc", doc), ("freq", freq)))
    out |= {f"verify_ans_{c}": _constant("context", c, 256, ("doc", "freq")) for c in ("max", "minmax", "med90p", "medmax")}
    out["verify_ans_packed"] = _constant("context", "packed", 256, ("doc", "freq"))
    return out
