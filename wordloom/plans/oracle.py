"""The queries as SQL over the same tables, for engines with the PostgreSQL-like dialect of list functions."""

from __future__ import annotations

from ..functions import normalize as N
from ..functions import pos as P
from ..operators.corpus import LIST_DOCUMENTS, STRIDE
from ..params import FREQUENT, MIN_DF, NEXT, OTHER, OWN_STOP_WORDS, PAGE, RAW, SCOPE, SEED, SEED2, TFIDF_RANGE, URLS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(sentence: str, stop_words: list[str] | tuple[str, ...] = tuple(N.STOP_WORDS)) -> str:
    text = f"lower({sentence})"
    for pattern in N.LINKS:
        text = f"regexp_replace({text}, {_q(pattern)}, '', 'g')"
    for pattern, replacement in N.SPLITS:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(replacement)}, 'g')"
    stop = ", ".join(map(_q, stop_words))
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: regexp_matches(w, {_q(N.TOKEN)}) AND w NOT IN ({stop}))"


_HELD = f"regexp_replace(coalesce(text, ''), {_q(N.ABBREVIATION)}, '\\1\\2.' || chr(2) || '\\3', 'g')"
_CUT = f"string_split(regexp_replace({_HELD}, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1))"
def _base(texts: str = "SELECT doc_id, text FROM documents", stop_words: list[str] | tuple[str, ...] = tuple(N.STOP_WORDS)) -> str:
    return f"""
cut AS (SELECT doc_id, {_CUT} AS parts FROM ({texts})),
rows_ AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS sent_pos FROM cut),
s AS MATERIALIZED (
  SELECT doc_id * {STRIDE} + sent_pos AS sid, doc_id AS source_document_index, sent_pos, original_text, {_tokens("original_text", stop_words)} AS tokens
  FROM (SELECT doc_id, sent_pos, replace(part, chr(2), '') AS original_text FROM rows_)
)"""


BASE = _base()
_POST = ", p AS MATERIALIZED (SELECT sid, unnest(list_distinct(tokens)) AS word FROM {s})"
_VOCAB = ", v AS MATERIALIZED (SELECT word, count(*) AS df FROM p GROUP BY word)"


def _with(body: str, scope: str = "s", more: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{_POST.format(s=scope)}{_VOCAB}{more} {body}"


def _has(word: str) -> str:
    return f"list_contains(tokens, {_q(word)})"


def _fit(name: str, scope: str, min_df: int = 2) -> str:
    """CTE name(sid, word, tf, df, raw)."""
    return f""", {name}_t AS (SELECT sid, word, count(*) AS tf FROM (SELECT sid, unnest(tokens) AS word FROM {scope}) WHERE length(word) >= 2 GROUP BY ALL),
{name}_v AS (SELECT word, count(*) AS df FROM {name}_t GROUP BY word HAVING count(*) >= {min_df}),
{name} AS MATERIALIZED (SELECT sid, word, tf, df, tf * (ln((1 + (SELECT count(*) FROM {scope}))::DOUBLE / (1 + df)) + 1) AS raw FROM {name}_t JOIN {name}_v USING (word))"""


def _assign(name: str, fit: str, excluded: tuple[str, ...] = (), weighted: bool = True) -> str:
    score = "raw * ln(1 + df)" if weighted else "raw"
    where = f"WHERE word NOT IN ({', '.join(map(_q, excluded))})" if excluded else ""
    return f""", {name} AS (SELECT sid, word FROM (SELECT sid, word, row_number() OVER (PARTITION BY sid ORDER BY round({score}, 9) DESC, word) AS r FROM {fit} {where}) WHERE r = 1)"""


_WEIGHTS = _fit("f", "s") + ", w AS (SELECT sid, word, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sid)) AS weight FROM f), means AS (SELECT word, avg(weight) AS mean_tfidf FROM w GROUP BY word)"
_PMI = "ln((cooc::DOUBLE / n) / ((seed_df::DOUBLE / n) * (df::DOUBLE / n)))"


def _tag(word: str = "word") -> str:
    cases = [f"WHEN {word} IN ({', '.join(map(_q, words.split()))}) THEN {_q(name)}" for name, words in P.CLOSED.items()]
    cases.append(f"WHEN regexp_matches({word}, '^[0-9]+$') THEN 'CD'")
    cases += [f"WHEN ends_with({word}, {_q(e)}) AND length({word}) >= {len(e) + 2} THEN {_q(name)}" for e, name in P.ENDINGS]
    return f"CASE {' '.join(cases)} ELSE 'NN' END"


def _cluster(seed: str = SEED, top: int | None = 20, scope: str = "s", score: str = f"{_PMI} * ln(1 + df)", where: str = "", percent: float = 0, least: float = 0.0, excluded: tuple[str, ...] = (), more: str = "", scope_cte: str = "") -> str:
    """CTEs up to c(word, score, df, cooc), limited to the top."""
    tests = [f"df >= 1 {where}"]
    drop = f"AND word NOT IN ({', '.join(map(_q, excluded))})" if excluded else ""
    body = f""", seeded AS (SELECT sid FROM {scope} WHERE {_has(seed)}),
together AS (SELECT word, count(*) AS cooc FROM p JOIN seeded USING (sid) WHERE word <> {_q(seed)} GROUP BY word),
counted AS (SELECT word, cooc, df, (SELECT count(*) FROM seeded) AS seed_df, (SELECT count(*) FROM {scope}) AS n FROM together JOIN v USING (word)),
scored AS (SELECT word, df, cooc, round({score}, 9) AS score FROM counted WHERE {tests[0]}),
kept AS (SELECT * FROM scored WHERE score > 0 AND score >= {least}),
c AS (SELECT word, score, df, cooc FROM kept WHERE score >= round((SELECT max(score) FROM kept) * {percent} / 100, 9) {drop} ORDER BY score DESC, word {f"LIMIT {top}" if top else ""})"""
    return f"WITH {BASE}{scope_cte}{_POST.format(s=scope)}{_VOCAB}{more}{body} "


_SHOW = "SELECT word, round(score, 6) AS score, df, cooc FROM c"
_NPMI = f"coalesce({_PMI} / nullif(-ln(cooc::DOUBLE / n), 0), 0)"
_USEFUL = f"AND {_tag()} IN ({', '.join(map(_q, P.USEFUL))})"
_SCOPE = f", sc AS (SELECT * FROM s WHERE {_has(SCOPE)})"
_PAIRS = """, lists AS MATERIALIZED (SELECT list_sort(list_distinct(tokens)) AS ws FROM s),
firsts AS (SELECT ws, unnest(ws) AS w1, unnest(range(1, len(ws) + 1)) AS i FROM lists),
pairs AS MATERIALIZED (SELECT w1, w2, count(*) AS cooc FROM (SELECT w1, unnest(ws[i + 1:]) AS w2 FROM firsts) GROUP BY ALL),
sp AS (SELECT w1, w2, cooc, d1.df AS df1, d2.df AS df2, (SELECT count(*) FROM s)::DOUBLE AS n FROM pairs JOIN v d1 ON d1.word = w1 JOIN v d2 ON d2.word = w2)"""
_PAIR_PMI = "ln((cooc / n) / ((df1 / n) * (df2 / n)))"
_SIZES = "SELECT word, count(*) AS size FROM {a} GROUP BY word"
_MEANS_SEED = _WEIGHTS
_URLS = "(SELECT page_id AS doc_id, " + URLS + " AS text FROM pages)"
_OFFSETS = "unnest(list_filter(range(0, greatest(length(original_text) - {n} + 1, 0)), lambda i: substr(lower(original_text), i + 1, {n}) = {w}))"


_HIT = "array_to_string(list_filter(range(0, greatest(length(original_text) - {n} + 1, 0)), lambda i: substr(lower(original_text), i + 1, {n}) = {w}), ',')"
_STATS = ("count(*) OVER () AS n_words, round(max(score) OVER (), 6) AS max_score, round(avg(score) OVER (), 6) AS mean_score, "
          "round(median(score) OVER (), 6) AS median_score, round(min(score) OVER (), 6) AS min_score")


def _shown(ids: str, words: list[str]) -> str:
    """A page of the sentences in a CTE, its hits, the total."""
    hits = ", ".join(f"{_HIT.format(n=len(w), w=_q(w))} AS hits_{k}" for k, w in enumerate(words))
    return f"SELECT sid, original_text, {hits}, (SELECT count(*) FROM {ids}) AS total FROM s WHERE sid IN (SELECT sid FROM {ids} ORDER BY sid LIMIT {PAGE[1]} OFFSET {PAGE[0]})"


def _iterated(seeds: list[str]) -> str:
    parts, scope = "", "s"
    for k, seed in enumerate(seeds):
        parts += _fit(f"f{k}", scope) + _assign(f"a{k}", f"f{k}")
        parts += f", s{k} AS MATERIALIZED (SELECT * FROM {scope} WHERE sid IN (SELECT sid FROM a{k} WHERE word = {_q(seed)}))"
        scope = f"s{k}"
    parts += _fit("fz", scope) + _assign("az", "fz", tuple(seeds))
    return f"WITH {BASE}{parts} SELECT word, count(*) AS size FROM az GROUP BY word"


_KEPT = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\p{Z}]')"
_NO_GERMAN = "SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS text FROM documents"

SQL: dict[str, str] = {
    "doc_scan_filtered": "SELECT doc_id AS doc_index, length(text) AS n FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\p{Z}]')",
    "csv_scan": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, text FROM ({_KEPT})",
    "load_pipeline": f"WITH {_base(_KEPT)} SELECT row_number() OVER (ORDER BY sid) - 1 AS sid, original_text, array_to_string(tokens, ' ') AS processed_text FROM s",
    "dataset_catalog": f"WITH {_base(_KEPT)} SELECT CAST(1 AS BIGINT) AS id, 'reddit' AS name, 'ready' AS status, count(*) AS sentence_count FROM s",
    "sentences_without_text": f"WITH {_base(_NO_GERMAN)} SELECT sid, original_text, array_to_string(tokens, ' ') AS processed_text FROM s",
    "sentences_own_stop_words": f"WITH {_base(stop_words=OWN_STOP_WORDS)} SELECT sid, array_to_string(tokens, ' ') AS processed_text FROM s",
    "conversations_user_only": "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'",
    "doc_cap": "SELECT doc_id AS doc_index, length(text) AS n FROM documents ORDER BY doc_id LIMIT 100",
    "sentences_split": f"WITH {BASE} SELECT row_number() OVER (ORDER BY sid) - 1 AS sentence_index, source_document_index, CAST(sent_pos AS BIGINT) AS sent_pos, original_text FROM s",
    "processed_text": f"WITH {BASE} SELECT sid, array_to_string(tokens, ' ') AS processed_text FROM s",
    "url_strip_literals": f"WITH t AS {_URLS} SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS processed_text FROM t",
    "word_total_freq": f"WITH {BASE} SELECT word, count(*) AS total_freq FROM (SELECT unnest(tokens) AS word FROM s) GROUP BY word",
    "vocab_top": _with(f"SELECT * FROM v ORDER BY df DESC, word LIMIT {FREQUENT}"),
    "vocab_least": _with(f"SELECT * FROM v ORDER BY df, word LIMIT {FREQUENT}"),
    "words_with_freq": _with("SELECT * FROM v WHERE df = 3"),
    "word_freq_lookup": _with(f"SELECT * FROM v WHERE word = {_q(SEED)}"),
    "posting_lists": _with(f"SELECT word, sid // {STRIDE * LIST_DOCUMENTS} AS block, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS sids FROM p GROUP BY ALL"),
    "posting_of_word": f"WITH {BASE} SELECT sid, len(list_filter(tokens, lambda w: w = {_q(SEED)})) AS tf FROM s WHERE {_has(SEED)}",
    "posting_ranges": _with("SELECT word, count(*) AS df, min(sid) AS first_sid, max(sid) AS last_sid FROM p GROUP BY word"),
    "seq_search_ids": f"WITH {BASE} SELECT sid FROM s WHERE {_has(SEED)} AND {_has(SEED2)}",
    "seq_search_related": _with("SELECT word, df FROM v", "sr", "").replace(_POST.format(s="sr"), f", sr AS (SELECT * FROM s WHERE {_has(SEED)} AND {_has(SEED2)})" + _POST.format(s="sr")),
    "and_contains": f"WITH {BASE} SELECT sid FROM s WHERE {_has(SEED)} AND {_has(OTHER)}",
    "seed_context_words": _with(f"SELECT DISTINCT word FROM p WHERE sid IN (SELECT sid FROM s WHERE {_has(SEED)}) AND word <> {_q(SEED)}"),
    "pair_cooc": _with("SELECT * FROM pairs", more=_PAIRS),
    "pair_lookup": _with(f"SELECT {_q(min(SEED, SEED2))} AS w1, {_q(max(SEED, SEED2))} AS w2, count(*) AS cooc FROM s WHERE {_has(SEED)} AND {_has(SEED2)}"),
    "pmi_pairs": _with(f"SELECT w1, w2, cooc, round({_PAIR_PMI}, 6) AS pmi FROM sp", more=_PAIRS),
    "npmi_pairs": _with(f"SELECT w1, w2, cooc, round(coalesce({_PAIR_PMI} / nullif(-ln(cooc / n), 0), 0), 6) AS npmi FROM sp", more=_PAIRS),
    "assoc_default": _cluster() + _SHOW,
    "assoc_seed_normalised": _cluster() + _SHOW,
    "assoc_npmi": _cluster(score=f"{_NPMI} * ln(1 + df)") + _SHOW,
    "assoc_min_freq": _cluster(where=f"AND df >= {MIN_DF}") + _SHOW,
    "assoc_unweighted": _cluster(score=_PMI) + _SHOW,
    "assoc_min_pmi": _cluster(top=None, least=2.0) + _SHOW,
    "assoc_pct30": _cluster(top=None, percent=30) + _SHOW,
    "assoc_tfidf_range": _cluster(more=_MEANS_SEED, where=f"AND coalesce((SELECT mean_tfidf FROM means m WHERE m.word = counted.word), 0) BETWEEN {TFIDF_RANGE[0]} AND {TFIDF_RANGE[1]}") + _SHOW,
    "pos_filtered_assoc": _cluster(where=_USEFUL) + _SHOW,
    "assoc_by_freq": _cluster(top=100, percent=30) + "SELECT word, round(score, 6) AS score, df, cooc FROM c ORDER BY df DESC, score DESC, word LIMIT 20",
    "pos_filter_batch": f"WITH {BASE} SELECT sid, array_to_string(list_filter(tokens, lambda w: {_tag('w')} IN ({', '.join(map(_q, P.USEFUL))})), ' ') AS words FROM s",
    "assoc_by_freq_5x": _cluster(top=50, percent=30) + "SELECT word, round(score, 6) AS score, df, cooc FROM c ORDER BY df DESC, score DESC, word LIMIT 10",
    "assoc_with_stats": _cluster(top=100, percent=30) + f"SELECT word, df, cooc, round(score, 6) AS score, {_STATS} FROM (SELECT * FROM c ORDER BY df DESC, score DESC, word LIMIT 20)",
    "assoc_with_freq": _cluster() + "SELECT word, df, round(score, 6) AS score FROM c",
    "assoc_with_sentences": _cluster() + "SELECT 'word' AS kind, word AS item, df, round(score, 6) AS score FROM c UNION ALL SELECT 'sentence', sid::VARCHAR, 0, 0 FROM seeded",
    "assoc_scoped": _cluster(top=100, scope="sc", scope_cte=_SCOPE, excluded=(SCOPE,)) + "SELECT word, round(score, 6) AS score, df, cooc FROM c ORDER BY cooc DESC, score DESC, word LIMIT 100",
    "assoc_stats": _cluster(top=None) + "SELECT count(*) AS n_words, round(coalesce(max(score), 0), 6) AS max_score, round(coalesce(avg(score), 0), 6) AS mean_score, round(coalesce(median(score), 0), 6) AS median_score, round(coalesce(min(score), 0), 6) AS min_score FROM c",
    "tfidf_weights": _with("SELECT sid, word, round(weight, 6) AS weight FROM w", more=_WEIGHTS),
    "tfidf_mean_all": _with("SELECT word, round(mean_tfidf, 6) AS mean_tfidf FROM means", more=_WEIGHTS),
    "tfidf_words": _with(f"SELECT q.word, round(coalesce(mean_tfidf, 0), 6) AS mean_tfidf FROM (VALUES ({_q(SEED)}), ({_q(SEED2)}), ('zzzunknown')) q(word) LEFT JOIN means ON q.word = means.word", more=_WEIGHTS),
    "top_words_tfidf": _with(f"SELECT t.word, t.df, round(coalesce(mean_tfidf, 0), 6) AS mean_tfidf FROM (SELECT * FROM v ORDER BY df DESC, word LIMIT {FREQUENT}) t LEFT JOIN means ON t.word = means.word", more=_WEIGHTS),
    "tfidf_export": _with(f"SELECT printf('%s: %.6f', t.word, coalesce(mean_tfidf, 0)) AS line FROM (SELECT * FROM v ORDER BY df DESC, word LIMIT {FREQUENT}) t LEFT JOIN means ON t.word = means.word", more=_WEIGHTS),
    "tfidf_cell": _with(f"SELECT round(coalesce(max(weight), 0), 6) AS weight FROM w WHERE word = {_q(SEED)} AND sid = (SELECT min(sid) FROM s WHERE {_has(SEED)})", more=_WEIGHTS),
    "excl_assign": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')} SELECT sid, word FROM a",
    "excl_sizes": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')} {_SIZES.format(a='a')}",
    "excl_top": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')}, z AS ({_SIZES.format(a='a')}) SELECT * FROM z WHERE size >= 2 ORDER BY size DESC, word LIMIT 20",
    "excl_least": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')}, z AS ({_SIZES.format(a='a')}) SELECT * FROM z ORDER BY size, word LIMIT 20",
    "excl_of_size": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')}, z AS ({_SIZES.format(a='a')}) SELECT * FROM z WHERE size = 3",
    "excl_sentences": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')}, ids AS (SELECT sid FROM a WHERE word = {_q(SEED)}) {_shown('ids', [SEED])}",
    "excl_drilled": f"WITH {BASE}{_fit('f', 's', 1)}{_assign('a', 'f', (), False)}, s1 AS MATERIALIZED (SELECT * FROM s WHERE sid IN (SELECT sid FROM a WHERE word = {_q(RAW)})){_fit('g', 's1', 1)}{_assign('b', 'g', (RAW,), False)} {_SIZES.format(a='b')}",
    "excl_first_n": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f')} SELECT sid, word FROM a WHERE sid IN (SELECT sid FROM s ORDER BY sid LIMIT 1000)",
    "excl_excluded": f"WITH {BASE}{_fit('f', 's')}{_assign('a', 'f', (SEED, SEED2))} SELECT sid, word FROM a",
    "excl_legacy": f"""WITH {BASE}{_fit('f', 's')}, pl AS (SELECT sid, word, min(place) AS place FROM (SELECT sid, unnest(tokens) AS word, unnest(range(0, len(tokens))) AS place FROM s) GROUP BY ALL),
a AS (SELECT sid, word FROM (SELECT sid, word, row_number() OVER (PARTITION BY sid ORDER BY round(raw * ln(1 + df), 9) DESC, place) AS r FROM f JOIN pl USING (sid, word)) WHERE r = 1)
SELECT s.sid, coalesce(a.word, '') AS word FROM s LEFT JOIN a ON s.sid = a.sid""",
    "excl_raw": f"WITH {BASE}{_fit('f', 's', 1)}{_assign('a', 'f', (), False)} {_SIZES.format(a='a')}",
    "excl_raw_scores": f"""WITH {BASE}{_fit('f', 's', 1)}{_assign('a', 'f', (), False)}, nm AS (SELECT sid, sqrt(sum(raw * raw)) AS norm FROM f GROUP BY sid)
SELECT DISTINCT word, round(raw / norm * log2(df), 6) AS score FROM f JOIN a USING (sid, word) JOIN nm USING (sid)""",
    "iter_excl_1seed": _iterated([SEED]),
    "iter_excl_2seed": _iterated([SEED, NEXT]),
    "processed_page": f"WITH {BASE} SELECT sid, array_to_string(tokens, ' ') AS processed_text FROM s WHERE {_has(SEED)} ORDER BY sid LIMIT {PAGE[1]} OFFSET {PAGE[0]}",
    "path_sentences": f"WITH {BASE}, ids AS (SELECT sid FROM s WHERE {_has(SEED)} AND {_has(SEED2)}) {_shown('ids', [SEED, SEED2])}",
    "sentence_page": f"WITH {BASE} SELECT sid, original_text FROM s WHERE {_has(SEED)} ORDER BY sid LIMIT {PAGE[1]} OFFSET {PAGE[0]}",
    "highlights": f"WITH {BASE} " + " UNION ALL ".join(f"SELECT sid, {_q(w)} AS word, CAST({_OFFSETS.format(n=len(w), w=_q(w))} AS BIGINT) AS at FROM s WHERE {_has(SEED)}" for w in (SEED, SEED2)),
}
