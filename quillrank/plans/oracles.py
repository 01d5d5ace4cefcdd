"""The catalogue's queries as DuckDB SQL, built from shared common tables."""

from __future__ import annotations

from ..operators import tuning
from ..operators.evaluate import CUTS, LEVELS
from . import settings as s

TOKEN = r"<[^>\n]*>?|[A-Za-z0-9][A-Za-z0-9-]*"


def _norm(t: str) -> str:
    """The normaliser of a lower-case token, as an expression."""
    return f"""left(CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y'
      WHEN length({t}) > 4 AND ({t} LIKE '%sses' OR {t} LIKE '%ches' OR {t} LIKE '%shes' OR {t} LIKE '%xes' OR {t} LIKE '%zes') THEN left({t}, length({t}) - 2)
      WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND {t} NOT LIKE '%us' AND {t} NOT LIKE '%is' AND {t} <> 'news' THEN left({t}, length({t}) - 1)
      ELSE {t} END, 255)"""


def _terms(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'), lambda t: NOT starts_with(t, '<')), lambda t: {_norm('lower(t)')})"


def _bm25(tf: str, length: str, mean: str, k1: str, b: str) -> str:
    return f"({tf} * ({k1} + 1.0) / ({tf} + {k1} * (1.0 - {b} + {b} * {length} / {mean})))"


K1, B = "CAST(0.7 AS DOUBLE)", "CAST(0.3 AS DOUBLE)"


def _scored(terms: str, k1: str = K1, b: str = B) -> str:
    return f"""SELECT q.topic_id, p.doc_ord, sum(q.weight * v.idf * {_bm25('CAST(p.tf AS DOUBLE)', 'p.doc_len', 'v.avg_len', k1, b)}) AS score
      FROM {terms} q JOIN gains v USING (term) JOIN postings p USING (term) GROUP BY q.topic_id, p.doc_ord"""


def _top(scores: str, n: int = 1000) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, doc_ord DESC) AS rank FROM {scores}) WHERE rank <= {n}"""


def _passages(docs: str, window: int) -> str:
    return f"""SELECT topic_id, doc_ord, max(total) AS passage FROM (
        SELECT topic_id, doc_ord, lo, hi, sum(gain * {_bm25('CAST(n AS DOUBLE)', 'CAST(hi - lo + 1 AS DOUBLE)', f'CAST({window} AS DOUBLE)', K1, B)}) AS total FROM (
          SELECT a.topic_id, a.doc_ord, a.pos AS lo, z.pos AS hi, m.term, m.gain, count(*) AS n
          FROM {docs}_hits a JOIN {docs}_hits z ON a.topic_id = z.topic_id AND a.doc_ord = z.doc_ord AND z.pos BETWEEN a.pos AND a.pos + {window - 1}
          JOIN {docs}_hits m ON a.topic_id = m.topic_id AND a.doc_ord = m.doc_ord AND m.pos BETWEEN a.pos AND z.pos
          GROUP BY ALL) GROUP BY topic_id, doc_ord, lo, hi HAVING count(*) > 1) GROUP BY topic_id, doc_ord HAVING max(total) > 0"""


def _hits(docs: str) -> str:
    return f"""SELECT d.topic_id, d.doc_ord, f.pos, f.term, q.weight * v.idf AS gain
      FROM {docs} d JOIN stream f USING (doc_ord) JOIN asked q ON q.topic_id = d.topic_id AND q.term = f.term JOIN gains v ON v.term = f.term"""


def _reranked(scores: str, passages: str, docs: int = 25, weight: str = "0.2") -> str:
    return f"""SELECT topic_id, doc_ord, s AS score, row_number() OVER (PARTITION BY topic_id ORDER BY prefix DESC, round(s, 9) DESC, doc_ord DESC) AS rank FROM (
        SELECT t.topic_id, t.doc_ord, t.rank <= {docs} AS prefix, t.score + CASE WHEN t.rank <= {docs} THEN coalesce(p.passage, 0) * CAST({weight} AS DOUBLE) ELSE 0 END AS s
        FROM {scores} t LEFT JOIN {passages} p USING (topic_id, doc_ord))"""


def _named(run: str) -> str:
    return f"SELECT topic_id, CAST(doc_ord AS VARCHAR) AS doc_no, score, rank FROM {run}"


def _fused(parts: list[tuple[str, float, int]]) -> str:
    union = " UNION ALL ".join(f"SELECT topic_id, doc_no, rank, CAST({w} AS DOUBLE) AS weight FROM {run} WHERE rank <= {depth}" for run, w, depth in parts)
    return f"""SELECT topic_id, doc_no, score, best_rank, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 12) DESC, best_rank, doc_no) AS rank
      FROM (SELECT topic_id, doc_no, sum(weight / (60.0::DOUBLE + rank)) AS score, min(rank) AS best_rank FROM ({union}) GROUP BY topic_id, doc_no)"""


def _tailed(parts: list[tuple[str, float, int]]) -> str:
    union = " UNION ALL ".join(f"SELECT topic_id, doc_no, {i} AS place, rank AS entry FROM {run}" for i, (run, _, _) in enumerate(parts))
    return f"""WITH fused AS ({_fused(parts)}), floors AS (SELECT topic_id, max(rank) AS n, arg_max(score, rank) AS floor FROM fused GROUP BY topic_id),
      rest AS (SELECT topic_id, doc_no, min(place * 1000000 + entry) AS spot FROM ({union}) u WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.topic_id = u.topic_id AND f.doc_no = u.doc_no) GROUP BY topic_id, doc_no),
      tail AS (SELECT topic_id, doc_no, row_number() OVER (PARTITION BY topic_id ORDER BY spot, doc_no) AS i FROM rest)
      SELECT topic_id, doc_no, score, rank FROM fused UNION ALL
      SELECT topic_id, doc_no, coalesce(floor, 0) - i * CAST(1e-9 AS DOUBLE), coalesce(n, 0) + i FROM tail LEFT JOIN floors USING (topic_id)"""


_BASE = {
    "docs": f"SELECT doc_id AS doc_ord, {_terms('text')} AS terms FROM documents",
    "forward": "SELECT doc_ord, terms, CAST(len(terms) AS BIGINT) AS doc_len FROM docs",
    "stream": "SELECT doc_ord, doc_len, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM forward",
    "stats": "SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM forward",
    "postings": "SELECT term, doc_ord, doc_len, count(*) AS tf FROM stream GROUP BY ALL",
    "vocab": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "gains": "SELECT term, ln(CAST(n_docs AS DOUBLE) / df) AS idf, avg_len FROM vocab, stats WHERE df < n_docs",
    "topics": f"SELECT CAST(item_id AS VARCHAR) AS topic_id, regexp_extract_all(text, '{TOKEN}')[1:2 + item_id % 6] AS raw FROM benchmark",
    "topic_words": f"SELECT topic_id, array_to_string(raw, ' ') AS text, list_transform(raw, lambda t: {_norm('lower(t)')}) AS words FROM topics",
    "asked": "SELECT topic_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT topic_id, unnest(words) AS term FROM topic_words) GROUP BY topic_id, term",
    "bm25": _scored("asked"),
    "bm25_top": _top("bm25"),
    "voters": """SELECT topic_id, doc_ord, CASE WHEN mass > 0 THEN greatest(score, 0) / mass ELSE 1.0 / rank END AS vote FROM (
        SELECT *, sum(greatest(score, 0)) OVER (PARTITION BY topic_id) AS mass FROM bm25_top WHERE rank <= 5 AND topic_id IN (SELECT topic_id FROM topic_words WHERE len(words) <= 6))""",
    "votes": """SELECT topic_id, term, sum(vote * tf / doc_len) AS vote FROM voters JOIN postings USING (doc_ord)
        WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.topic_id = voters.topic_id AND a.term = postings.term) GROUP BY topic_id, term""",
    "best_votes": """SELECT * FROM (SELECT topic_id, term, vote * idf AS gain, row_number() OVER (PARTITION BY topic_id ORDER BY round(vote * idf, 12) DESC, term) AS place
        FROM votes JOIN gains USING (term) WHERE vote * idf > 0) WHERE place <= 6""",
    "expansion": "SELECT topic_id, term, gain / sum(gain) OVER (PARTITION BY topic_id) * CAST(0.45 AS DOUBLE) AS weight FROM best_votes",
    "extra": _scored("expansion"),
    "rm3": "SELECT topic_id, doc_ord, sum(score) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM extra) GROUP BY topic_id, doc_ord",
    "rm3exp": "SELECT * FROM extra UNION ALL SELECT * FROM bm25 WHERE topic_id NOT IN (SELECT topic_id FROM expansion)",
    "rm3_top": _top("rm3"),
    "rm3exp_top": _top("rm3exp"),
    "first": "SELECT topic_id, doc_ord FROM bm25_top WHERE rank <= 25",
    "first_hits": _hits("first"),
    "first_rm3": "SELECT topic_id, doc_ord FROM rm3_top WHERE rank <= 25",
    "first_rm3_hits": _hits("first_rm3"),
    "passages": _passages("first", 16),
    "passages_rm3": _passages("first_rm3", 16),
    "run_bm25": _named("bm25_top"),
    "run_rm3": _named("rm3_top"),
    "run_rm3exp": _named("rm3exp_top"),
    "relevant": "SELECT DISTINCT CAST(item_id AS VARCHAR) AS topic_id, CAST(doc_id AS VARCHAR) AS doc_no FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 60))",
    "qrels": """SELECT topic_id, doc_no, 1 AS rel FROM relevant UNION ALL
        SELECT t.topic_id, l.doc_no, 0 FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_no FROM labels WHERE quality = 0) l, topics t
        WHERE NOT EXISTS (SELECT 1 FROM relevant r WHERE r.topic_id = t.topic_id AND r.doc_no = l.doc_no)""",
    "judged": "SELECT topic_id, sum(rel) AS num_rel, count(*) - sum(rel) AS num_nonrel FROM qrels GROUP BY topic_id HAVING sum(rel) > 0",
}


def _printed(run: str) -> str:
    """Scores at four places, as a run file shows them."""
    return f"SELECT * REPLACE (CAST(format('{{:.4f}}', score) AS DOUBLE) AS score) FROM {run}"


def _measured(run: str, by: str = "") -> dict[str, str]:
    """Common tables that end in ``measures``: one row per (``by``, topic)."""
    keys = f"{by}, topic_id" if by else "topic_id"
    cells = f"(SELECT * FROM (SELECT DISTINCT {by} FROM printed), judged) cell" if by else "judged"
    cuts = ", ".join(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hits_{k}" for k in CUTS)
    levels = ", ".join(f"max(CASE WHEN found >= ceil(CAST({x} AS DOUBLE) * num_rel - 1e-9) THEN later END) AS iprec_{int(x * 10)}" for x in LEVELS)
    named = ", ".join([f"coalesce(hits_{k}, 0) / CAST({k} AS DOUBLE) AS P_{k}" for k in CUTS] + [f"coalesce(iprec_{int(x * 10)}, 0) AS iprec_at_recall_{x:.2f}".replace(".", "_") for x in LEVELS])
    return {
        "printed": _printed(run),
        "listed": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_no DESC) AS place FROM printed) WHERE place <= 1000",
        "hits": f"""SELECT l.* EXCLUDE (place), place AS rank, num_rel, num_nonrel, coalesce(rel, 0) AS hit, sum(coalesce(rel, 0)) OVER w AS found, sum(CASE WHEN rel = 0 THEN 1 ELSE 0 END) OVER w AS above
            FROM (SELECT {keys}, doc_no, place FROM listed) l JOIN judged USING (topic_id) LEFT JOIN qrels USING (topic_id, doc_no) WINDOW w AS (PARTITION BY {keys} ORDER BY place ROWS UNBOUNDED PRECEDING)""",
        "curve": f"SELECT *, max(found / rank) OVER (PARTITION BY {keys} ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM hits",
        "sums": f"""SELECT {keys}, count(*) AS num_ret, sum(hit) AS num_rel_ret, sum(CASE WHEN hit = 1 THEN found / rank ELSE 0 END) AS ap, sum(CASE WHEN rank <= num_rel THEN hit ELSE 0 END) AS r_hits,
            sum(CASE WHEN hit = 0 THEN 0 WHEN above = 0 THEN 1 ELSE 1 - least(above, num_rel) / greatest(least(num_rel, num_nonrel), 1) END) AS pref,
            min(CASE WHEN hit = 1 THEN rank END) AS first_hit, {cuts}, {levels} FROM curve GROUP BY {keys}""",
        "measures": f"""SELECT {keys}, CAST(coalesce(num_ret, 0) AS DOUBLE) AS num_ret, CAST(num_rel AS DOUBLE) AS num_rel, CAST(coalesce(num_rel_ret, 0) AS DOUBLE) AS num_rel_ret,
            coalesce(ap, 0) / num_rel AS map, coalesce(r_hits, 0) / num_rel AS Rprec, coalesce(pref, 0) / num_rel AS bpref, coalesce(1.0 / first_hit, 0) AS recip_rank, {named} FROM {cells} LEFT JOIN sums USING ({keys})""",
    }


def _sql(final: str, more: dict[str, str] | None = None) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (_BASE | (more or {})).items()) + "\n" + final


def _published(run: str, where: str = "") -> str:
    return f"SELECT topic_id, doc_ord, rank, round(score, 6) AS score FROM {run} {where}"


def _named_out(places: int = 9) -> str:
    return f"SELECT topic_id, doc_no, rank, round(score, {places}) AS score FROM out"


_TWO = [("run_bm25", 0.6, 250), ("run_rm3", 0.4, 250)]
_TRI = [("run_bm25", 0.05, 250), ("run_rm3", 0.55, 250), ("run_rm3exp", 0.40, 250)]
_SHALLOW = [("run_bm25", 0.6, 20), ("run_rm3", 0.4, 20)]


def _grid_values(values: tuple) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"


def _measure_sql(*names: str) -> str:
    return _sql("SELECT topic_id, " + ", ".join(f"round({n.replace('.', '_')}, 9) AS {n.replace('.', '_')}" for n in names) + " FROM measures", _measured("run_bm25"))


def _rewrite() -> str:
    answers = f"SELECT CAST(item_id AS VARCHAR) AS topic_id, array_to_string(regexp_extract_all(text, '{TOKEN}')[2:10], ' ') AS answer FROM benchmark"
    told = """SELECT topic_id, asked_terms, list_filter(told, lambda t, i: list_position(told, t) = i)[1:8] AS told FROM (
        SELECT t.topic_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS asked_terms, regexp_extract_all(lower(answer), '[a-z0-9]+') AS told FROM topic_words t JOIN answers USING (topic_id))"""
    new = "SELECT *, list_filter(told, lambda t: NOT list_contains(asked_terms, t))[1:CASE WHEN len(asked_terms) <= 1 THEN 3 ELSE 1 END] AS new FROM told"
    kept = "SELECT topic_id, asked_terms, list_filter(told, lambda t: list_contains(asked_terms, t) OR list_contains(new, t)) AS kept FROM new"
    return _sql("SELECT topic_id, CASE WHEN kept = asked_terms THEN '' ELSE coalesce(array_to_string(kept, ' '), '') END AS rewrite FROM kept", {"answers": answers, "told": told, "new": new, "kept": kept})


_MONO = {
    "mono": """SELECT topic_id, doc_no, score, source_rank, llm_score, row_number() OVER (PARTITION BY topic_id ORDER BY source_rank > 85, llm_score DESC NULLS LAST, round(score, 9) DESC, source_rank) AS rank,
        CAST(count(*) OVER (PARTITION BY topic_id) AS DOUBLE) AS n FROM (
        SELECT topic_id, doc_no, score, rank AS source_rank, CASE WHEN rank <= 85 THEN (CAST(topic_id AS BIGINT) * 31 + CAST(doc_no AS BIGINT) * 17) % 101 END AS llm_score FROM run_bm25)""",
}
_DUO = _MONO | {
    "pairs": "SELECT a.topic_id, a.doc_no AS doc_a, b.doc_no AS doc_b FROM mono a JOIN mono b ON a.topic_id = b.topic_id AND a.rank < b.rank WHERE b.rank <= 10",
    "won": "SELECT topic_id, CASE WHEN (CAST(doc_a AS BIGINT) * 7 + CAST(doc_b AS BIGINT) * 13 + CAST(topic_id AS BIGINT)) % 3 < 2 THEN doc_a ELSE doc_b END AS doc_no, count(*) AS won FROM pairs GROUP BY ALL",
    "duo": "SELECT m.*, CASE WHEN m.rank <= 10 THEN coalesce(won, 0) END AS wins FROM mono m LEFT JOIN won USING (topic_id, doc_no)",
}
_DUO_OUT = """SELECT topic_id, doc_no, place AS rank, CAST(wins AS BIGINT) AS wins, n - place + 1 AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY rank > 10, wins DESC NULLS LAST,
    CASE WHEN rank <= 10 THEN -llm_score END, CASE WHEN rank <= 10 THEN -round(score, 9) END, CASE WHEN rank <= 10 THEN source_rank END, rank) AS place FROM duo)"""

_PARSE = """WITH made AS (SELECT doc_id, CAST(doc_id * 37 % 131 AS VARCHAR) AS n FROM documents), texts AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"score": ' || n || '}' WHEN 1 THEN 'about ' || n || ' of 100' WHEN 2 THEN '-' || n END AS text FROM made)
SELECT doc_id, text, CAST(CASE WHEN text IS NOT NULL THEN greatest(0, least(100, CAST(regexp_extract(text, '-?[0-9]+') AS BIGINT))) END AS BIGINT) AS score,
  CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS winner FROM texts"""

_PAGES = f"""WITH tokens AS (
  SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{TOKEN}') AS t FROM pages)
), tagged AS (
  SELECT *, CASE WHEN starts_with(token, '<') AND regexp_extract(token, '^<(/?[A-Za-z0-9]+)', 1) <> '' THEN '<' || lower(regexp_extract(token, '^<(/?[A-Za-z0-9]+)', 1)) || '>' ELSE token END AS tag FROM tokens
), lined AS (
  SELECT *, coalesce(last_value(CASE tag WHEN '<title>' THEN 1 WHEN '</title>' THEN 0 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS boosted FROM tagged
), state AS (
  SELECT *, sum(CASE WHEN tag IN ('<script>', '<style>') THEN 1 ELSE 0 END) OVER w AS seg, last_value(CASE WHEN tag IN ('<script>', '<style>') THEN tag END IGNORE NULLS) OVER w AS opener
  FROM lined WHERE tag NOT IN ('<title>', '</title>') WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), closed AS (
  SELECT *, max(CASE WHEN tag = '</' || substring(opener, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, seg ORDER BY pos ROWS UNBOUNDED PRECEDING) AS closed FROM state
)
SELECT page_id, term, CAST(sum(CASE boosted WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS tf FROM (
  SELECT page_id, boosted, {_norm('lower(token)')} AS term FROM closed WHERE (seg = 0 OR closed = 1) AND NOT starts_with(token, '<')) GROUP BY page_id, term"""


def _branches() -> str:
    rows = ", ".join(f"('{b}', '{t}', CAST({m} AS DOUBLE), {r}, {f})" for b, t, m, r, f in s.BRANCHES)
    return f"""WITH m AS (SELECT branch, strptime(stamp, '%Y%m%d-%H%M%S') AS happened, map, rel, ret FROM (VALUES {rows}) v(branch, stamp, map, rel, ret)),
      o AS (SELECT *, row_number() OVER w AS place, lag(map) OVER w AS before, first_value(map) OVER w AS base FROM m WINDOW w AS (ORDER BY branch <> 'original', happened, branch))
      SELECT branch, strftime(happened, '%Y-%m-%d %H:%M:%S') AS "at", place, round(CAST(ret AS DOUBLE) / rel, 9) AS recall, round(map - before, 9) AS map_delta_vs_previous,
        round(map - base, 9) AS map_delta_vs_original, round((map - base) / base * 100, 9) AS map_change_percent FROM o"""


def _passage_grid() -> str:
    more, parts = {}, []
    for w in s.GRID_WINDOWS:
        more[f"passages_{w}"] = _passages("first", w)
        for d in s.GRID_DOCS:
            parts += [f"SELECT {d} AS docs, {w} AS \"window\", CAST({x} AS DOUBLE) AS weight, * FROM ({_reranked('bm25_top', f'passages_{w}', d, str(x))})" for x in s.GRID_WEIGHTS]
    return _sql('SELECT docs, "window", weight, topic_id, doc_ord, rank, round(score, 6) AS score FROM out WHERE rank <= 100', more | {"out": " UNION ALL ".join(parts)})


def _bm25_grid() -> str:
    found = "SELECT q.topic_id, p.doc_ord, p.tf, p.doc_len, v.avg_len, q.weight * v.idf AS gain FROM asked q JOIN gains v USING (term) JOIN postings p USING (term)"
    cells = f"SELECT * FROM (SELECT unnest({_grid_values(tuning.BM25_K1)}) AS k1), (SELECT unnest({_grid_values(tuning.BM25_B)}) AS b)"
    scores = f"SELECT k1, b, topic_id, doc_ord, sum(gain * {_bm25('CAST(tf AS DOUBLE)', 'doc_len', 'avg_len', 'k1', 'b')}) AS score FROM found, cells GROUP BY ALL"
    ranked = "SELECT k1, b, topic_id, CAST(doc_ord AS VARCHAR) AS doc_no, score FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, topic_id ORDER BY round(score, 9) DESC, doc_ord DESC) AS rank FROM grid_scores) WHERE rank <= 1000"
    names = ", ".join(f"round(avg({n}), 9) AS {n}" for n in ("map", "Rprec", "P_10", "bpref", "recip_rank"))
    return _sql(f"SELECT k1, b, {names} FROM measures GROUP BY k1, b", {"found": found, "cells": cells, "grid_scores": scores, "ranked": ranked} | _measured("ranked", "k1, b"))


def _simplex(step: float, low: float, high: float) -> str:
    n, a, z = round(1 / step), round(low / step), round(high / step)
    return f"""SELECT a / CAST({n} AS DOUBLE) AS w1, b / CAST({n} AS DOUBLE) AS w2, ({n} - a - b) / CAST({n} AS DOUBLE) AS w3
      FROM (SELECT unnest(range({a}, {z + 1})) AS a), (SELECT unnest(range({a}, {z + 1})) AS b) WHERE {n} - a - b BETWEEN {a} AND {z}"""


def _fusion_grid() -> str:
    union = " UNION ALL ".join(f"SELECT topic_id, doc_no, rank, {i} AS place FROM {r} WHERE rank <= 250" for i, r in enumerate(("run_bm25", "run_rm3", "run_rm3exp")))
    shares = "SELECT topic_id, doc_no, min(rank) AS best_rank, " + ", ".join(f"sum(CASE WHEN place = {i} THEN 1.0::DOUBLE / (60.0::DOUBLE + rank) ELSE 0 END) AS r{i + 1}" for i in range(3)) + f" FROM ({union}) GROUP BY topic_id, doc_no"
    scored = "SELECT *, w1 * r1 + w2 * r2 + w3 * r3 AS score FROM shares, cells"
    out = "SELECT *, row_number() OVER (PARTITION BY w1, w2, w3, topic_id ORDER BY round(score, 12) DESC, best_rank, doc_no) AS rank FROM scored"
    return _sql("SELECT w1, w2, w3, topic_id, doc_no, rank, round(score, 9) AS score FROM out WHERE rank <= 50", {"shares": shares, "cells": _simplex(0.25, 0.25, 0.75), "scored": scored, "out": out})


_CELL_MEASURES = ", ".join(f"round(avg({n}), 9) AS {n}" for n in ("map", "Rprec", "P_10", "bpref", "recip_rank"))


def _passage_grid_measures() -> str:
    more, parts = {"wide": f"SELECT * FROM bm25_top WHERE rank <= {max(tuning.RERANK_DOCS)}", "wide_hits": _hits("wide")}, []
    for w in tuning.RERANK_WINDOWS:
        more[f"passages_{w}"] = _passages("wide", w)
        for d in tuning.RERANK_DOCS:
            parts += [f"SELECT {d} AS docs, {w} AS \"window\", CAST({x} AS DOUBLE) AS weight, topic_id, CAST(doc_ord AS VARCHAR) AS doc_no, score FROM ({_reranked('bm25_top', f'passages_{w}', d, str(x))})" for x in tuning.RERANK_WEIGHTS]
    return _sql(f'SELECT docs, "window", round(weight, 6) AS weight, {_CELL_MEASURES} FROM measures GROUP BY docs, "window", weight', more | {"out": " UNION ALL ".join(parts)} | _measured("out", 'docs, "window", weight'))


def _fusion_grid_measures() -> str:
    union = " UNION ALL ".join(f"SELECT topic_id, doc_no, rank, {i} AS place FROM {r} WHERE rank <= 250" for i, r in enumerate(("run_bm25", "run_rm3", "run_rm3exp")))
    shares = "SELECT topic_id, doc_no, " + ", ".join(f"sum(CASE WHEN place = {i} THEN 1.0::DOUBLE / (60.0::DOUBLE + rank) ELSE 0 END) AS r{i + 1}" for i in range(3)) + f" FROM ({union}) GROUP BY topic_id, doc_no"
    out = "SELECT w1, w2, w3, topic_id, doc_no, w1 * r1 + w2 * r2 + w3 * r3 AS score FROM shares, cells"
    return _sql(f"SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, {_CELL_MEASURES} FROM measures GROUP BY w1, w2, w3", {"shares": shares, "cells": _simplex(0.05, 0.05, 0.9), "out": out} | _measured("out", "w1, w2, w3"))


def all_sql() -> dict[str, str]:
    """DuckDB SQL of every query in the catalogue."""
    iprec = [f"iprec_at_recall_{x:.2f}" for x in LEVELS]
    parsed = f"regexp_extract_all(text, '{TOKEN}')"
    cost = "round(input_tokens / 1e6::DOUBLE * 0.25::DOUBLE + output_tokens / 1e6::DOUBLE * 2.0::DOUBLE, 9)"
    words = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> ''))"
    return {
        "tokenize": f"SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, {parsed} AS t FROM documents)",
        "normalize_terms": _sql("SELECT term, count(*) AS n FROM stream GROUP BY term"),
        "doc_lengths": _sql("SELECT doc_ord, doc_len FROM forward"),
        "postings": _sql("SELECT term, doc_ord, tf FROM postings"),
        "vocab_df": _sql("SELECT term, df, round(ln(CAST(n_docs AS DOUBLE) / df), 9) AS idf FROM vocab, stats"),
        "collection_stats": _sql("SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats"),
        "topics_parse": _sql("SELECT topic_id, unnest(range(len(words))) AS pos, unnest(words) AS term FROM topic_words"),
        "bm25_top1000": _sql(_published("bm25_top")),
        "bm25_params": _sql(_published("out"), {"other": _scored("asked", "CAST(1.2 AS DOUBLE)", "CAST(0.75 AS DOUBLE)"), "out": _top("other")}),
        "prf_terms": _sql("SELECT topic_id, term, round(weight, 6) AS weight FROM expansion"),
        "rm3_run": _sql(_published("rm3_top")),
        "rm3_expansion_only": _sql(_published("rm3exp_top")),
        "passage_scores": _sql("SELECT topic_id, doc_ord, round(passage, 6) AS passage FROM passages"),
        "passage_rerank": _sql(_published("out"), {"out": _reranked("bm25_top", "passages")}),
        "sparse_default": _sql(_published("out"), {"out": _reranked("rm3_top", "passages_rm3")}),
        "dense_topk": """SELECT topic_id, doc_ord, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, doc_ord) AS rank FROM (
            SELECT CAST(q.vec_id AS VARCHAR) AS topic_id, v.vec_id AS doc_ord, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id < 10)) WHERE rank <= 100""",
        "dense_every_20th": """SELECT topic_id, doc_ord, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, doc_ord) AS rank FROM (
            SELECT CAST(q.vec_id AS VARCHAR) AS topic_id, v.vec_id AS doc_ord, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 1000""",
        "l2_normalize": """SELECT vec_id, unnest(range(len(e))) AS pos, round(unnest(e) / n, 9) AS x FROM (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""",
        "rrf_two": _sql(_named_out(), {"out": _fused(_TWO)}),
        "rrf_tri": _sql(_named_out(), {"out": _fused(_TRI)}),
        "rrf_tail": _sql(_named_out(), {"out": _tailed(_SHALLOW)}),
        "fusion_ablations": _sql(
            "SELECT 'bm25' AS name, topic_id, doc_no, rank, round(score, 6) AS score FROM run_bm25 WHERE rank <= 100 UNION ALL SELECT 'bm25_rm3', topic_id, doc_no, rank, round(score, 8) FROM two WHERE rank <= 100 UNION ALL SELECT 'bm25_rm3_rm3exp', topic_id, doc_no, rank, round(score, 8) FROM tri WHERE rank <= 100",
            {"two": _tailed(_TRI[:2]), "tri": _tailed(_TRI)},
        ),
        "fusion_ablations_whole": _sql(
            "SELECT 'bm25' AS name, topic_id, doc_no, rank, round(score, 6) AS score FROM run_bm25 UNION ALL SELECT 'bm25_rm3', topic_id, doc_no, rank, round(score, 8) FROM two UNION ALL SELECT 'bm25_rm3_rm3exp', topic_id, doc_no, rank, round(score, 8) FROM tri",
            {"two": _tailed(_TRI[:2]), "tri": _tailed(_TRI)},
        ),
        "rewrite_eligible": _sql("SELECT topic_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) BETWEEN 1 AND 3 AS eligible FROM topic_words"),
        "rewrite_normalize": _rewrite(),
        "mono_rerank": _sql("SELECT topic_id, doc_no, rank, llm_score, n - rank + 1 AS final_score FROM mono", _MONO),
        "duo_rerank": _sql(_DUO_OUT, _DUO),
        "llm_parse": _PARSE,
        "llm_usage_cost": f"""SELECT calls, hits, misses, input_tokens, output_tokens, {cost} AS cost FROM (SELECT count(*) AS calls, count(*) FILTER (doc_id % 4 = 0) AS hits, count(*) FILTER (doc_id % 4 <> 0) AS misses,
            CAST(sum({words}) AS BIGINT) AS input_tokens, CAST(5 * count(*) AS BIGINT) AS output_tokens FROM documents)""",
        "doc_text_prefix": _sql("SELECT doc_ord, coalesce(array_to_string(terms[1:220], ' '), '') AS doc_text FROM forward"),
        "eval_map": _measure_sql("map"),
        "eval_rprec": _measure_sql("Rprec"),
        "eval_bpref": _measure_sql("bpref"),
        "eval_recip_rank": _measure_sql("recip_rank"),
        "eval_iprec": _measure_sql(*iprec),
        "eval_pk": _measure_sql(*[f"P_{k}" for k in CUTS]),
        "eval_counts": _measure_sql("num_ret", "num_rel", "num_rel_ret"),
        "eval_gm_map": _sql("SELECT round(avg(map), 9) AS map, round(exp(avg(ln(greatest(map, 1e-5)))), 9) AS gm_map, round(sum(num_rel_ret) / sum(num_rel), 9) AS recall FROM measures", _measured("run_bm25")),
        "bm25_grid": _bm25_grid(),
        "passage_grid": _passage_grid(),
        "fusion_simplex": f"SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3 FROM ({_simplex(0.05, 0.05, 0.9)})",
        "fusion_grid": _fusion_grid(),
        "passage_grid_measures": _passage_grid_measures(),
        "fusion_grid_measures": _fusion_grid_measures(),
        "page_fields": _PAGES,
        "branch_report": _branches(),
        "timing_summary": "SELECT event_type AS label, min(value) AS fastest, max(value) AS slowest, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type",
        "estimated_tokens": f"SELECT doc_id, CAST({words} AS BIGINT) AS tokens FROM documents",
        "body_term_counts": _sql("SELECT lang, count(*) AS docs, CAST(sum(doc_len) AS BIGINT) AS terms FROM forward JOIN documents ON doc_ord = doc_id GROUP BY lang"),
    }
